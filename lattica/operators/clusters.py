"""Clusters of nodes: reports, boundary edges, names, warnings, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import service_name, simple_name
from .merge import first_wins_mode

#: Thresholds of the warnings: links out of a class, cohesion, edges out of a service.
MAX_COUPLING, MIN_COHESION, MAX_CALLS = 5.0, 0.3, 10


def with_clusters(edges: DataFrame, assignment: DataFrame, how: str = "inner") -> DataFrame:
    """edges with src_cluster and dst_cluster, of assignment (id, cluster_id)."""
    ends = lambda side: assignment.select(F.col("id").alias(side), F.col("cluster_id").alias(f"{side}_cluster"))
    return edges.join(ends("src"), "src", how).join(ends("dst"), "dst", how)


def edge_counts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, internal, external): directed edges within, and edges out of and into the cluster."""
    both = with_clusters(edges.select("src", "dst"), assignment, "left")
    same = F.col("src_cluster") == F.col("dst_cluster")
    counted = both.groupBy("src_cluster", "dst_cluster").agg(F.count("*").alias("n"))  # at most clusters squared rows
    out = counted.where("src_cluster IS NOT NULL").select(F.col("src_cluster").alias("cluster_id"), F.when(same, F.col("n")).otherwise(0).alias("i"), F.when(same, 0).otherwise(F.col("n")).alias("e"))
    into = counted.where("dst_cluster IS NOT NULL").where(~F.coalesce(same, F.lit(False))).select(F.col("dst_cluster").alias("cluster_id"), F.lit(0).alias("i"), F.col("n").alias("e"))
    out = out.withColumn("i", F.coalesce("i", F.lit(0))).withColumn("e", F.coalesce("e", F.lit(0)))
    return out.unionByName(into).groupBy("cluster_id").agg(F.sum("i").alias("internal"), F.sum("e").alias("external"))


def cluster_report(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, lists: bool = True) -> DataFrame:
    """A row for each cluster: size, cohesion, coupling, complexity, dominant type, base name; with lists the classes, entities and entry points.

    Cohesion is directed internal edges by pairs of classes, 0 for one class; coupling is external edges by classes.
    Equally common types go to the one whose node comes first.
    """
    members = assignment.join(nodes, "id", "left").withColumn("type", F.coalesce("type", F.lit("Unknown")))
    by_seq = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("node_seq", "id")))), lambda x: x["id"])
    listed = [F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "id"))), lambda x: x["id"]).alias("classes"), by_seq("Entity").alias("entities"), by_seq("Controller").alias("entry_points")] if lists else []
    totals = members.groupBy("cluster_id").agg(
        F.count("*").alias("class_count"),
        F.sum(F.coalesce("complexity_score", F.lit(0))).alias("complexity_score"),
        F.min_by(F.when(F.col("type") == "Entity", simple_name(F.col("simple_name"), F.col("id"))), F.when(F.col("type") == "Entity", F.col("node_seq"))).alias("first_entity"),
        *listed,
    )
    kinds = first_wins_mode(members, ["cluster_id"], "type", "node_seq").withColumnRenamed("type", "dominant_type")
    packages = first_wins_mode(members.withColumn("package", F.nullif("package", F.lit(""))), ["cluster_id"], "package", "node_seq")
    n = F.col("class_count")
    rows = totals.join(edge_counts(edges, assignment), "cluster_id", "left").join(kinds, "cluster_id", "left").join(packages, "cluster_id", "left")
    return rows.select(
        "cluster_id", "class_count",
        F.when(n > 1, F.coalesce("internal", F.lit(0)) / (n * (n - 1) / 2)).otherwise(0.0).alias("internal_cohesion"),
        (F.coalesce("external", F.lit(0)) / n).alias("external_coupling"),
        "complexity_score", "dominant_type",
        service_name(F.col("first_entity"), F.lower("package"), F.col("cluster_id")).alias("base_name"),
        *(["classes", "entities", "entry_points"] if lists else []),
    )


def stack_report(nodes: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """The report whose cohesion also rewards few packages and complete stacks of entity, controller and repository in each.

    Ids without a node count as of type Unknown.
    """
    package = F.when(F.instr("id", ".") > 0, F.regexp_replace("id", r"\.[^.]*$", "")).otherwise("")
    members = assignment.join(nodes.select("id", "type"), "id", "left").withColumn("pkg", package)
    has = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int"))
    stacks = members.groupBy("cluster_id", "pkg").agg(
        F.count("*").alias("n"),
        ((has(F.col("type") == "Entity") + has(F.col("type") == "Controller") + has((F.col("type") == "Repository") | F.col("id").contains("Repository"))) / 3.0).alias("complete"),
    )
    totals = stacks.groupBy("cluster_id").agg(F.sum("n").alias("class_count"), F.count("*").alias("packages"), F.avg("complete").alias("completeness"))
    n = F.col("class_count")
    rows = totals.join(edge_counts(edges, assignment), "cluster_id", "left")
    edge = F.when(n > 1, F.coalesce("internal", F.lit(0)) / (n * (n - 1) / 2)).otherwise(0.0)
    return rows.select(
        "cluster_id", "class_count", "packages",
        F.greatest(edge, (1.0 / F.col("packages")) * (0.5 + 0.5 * F.col("completeness"))).alias("internal_cohesion"),
        (F.coalesce("external", F.lit(0)) / n).alias("external_coupling"),
    )


def dedup_names(rows: DataFrame, base: str, seq: str, name: str = "name") -> DataFrame:
    """The first x stays x, later ones become x-2, x-3 ..; a made name that is also someone's base name moves on to the next free number."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(seq))
    numbered = rows.withColumn("_n", nth)
    # Numbers that are taken by a natural name of the same stem.
    taken = rows.select(F.regexp_extract(base, r"^(.*)-(\d+)$", 1).alias("_stem"), F.regexp_extract(base, r"^(.*)-(\d+)$", 2).alias("_k")).where("_k != ''").distinct()
    taken = taken.groupBy("_stem").agg(F.array_sort(F.collect_set(F.expr("try_cast(_k AS int)"))).alias("_taken"))
    numbered = numbered.join(taken, F.col(base) == F.col("_stem"), "left")
    # Each taken number at or below the running one pushes it up.
    pushed = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda acc, k: F.when((F.col("_n") > 1) & (k >= 2) & (k <= acc), acc + 1).otherwise(acc))
    return numbered.withColumn(name, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), pushed.cast("string")))).drop("_n", "_stem", "_taken")


def boundary_edges(edges: DataFrame, assignment: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edges between clusters, with services' names (cluster_id, name) or else service-<id>; seq, the place of an edge, is kept if there."""
    cross = with_clusters(edges, assignment).where("src_cluster <> dst_cluster")
    fallback = lambda side: F.concat(F.lit("service-"), F.col(f"{side}_cluster").cast("string"))
    order = ["seq"] if "seq" in edges.columns else []
    if names is not None:
        for side in ("src", "dst"):
            cross = cross.join(names.select(F.col("cluster_id").alias(f"{side}_cluster"), F.col("name").alias(f"{side}_name")), f"{side}_cluster", "left")
    named = lambda side: F.coalesce(f"{side}_name", fallback(side)) if names is not None else fallback(side)
    return cross.select(
        named("src").alias("from_service"), named("dst").alias("to_service"), F.col("src").alias("from_class"), F.col("dst").alias("to_class"),
        F.col("method_name").alias("method"), F.col("type").alias("edge_type"), "weight", *order,
    )


def warnings(report: DataFrame, boundary: DataFrame) -> DataFrame:
    """(kind, service, number) for coupling, cohesion and calls beyond the thresholds. report has a column name."""
    row = lambda df, kind, service, number: df.select(F.lit(kind).alias("kind"), F.col(service).alias("service"), F.col(number).cast("double").alias("number"))
    calls = boundary.groupBy("from_service").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CALLS)
    return (
        row(report.where(F.col("external_coupling") > MAX_COUPLING), "HIGH_COUPLING", "name", "external_coupling")
        .unionByName(row(report.where(F.col("internal_cohesion") < MIN_COHESION), "LOW_COHESION", "name", "internal_cohesion"))
        .unionByName(row(calls, "MANY_BOUNDARY_CALLS", "from_service", "n"))
    )


def warning_text(kind, service, number):
    """The sentence of a warning; fixed values."""
    return (
        F.when(kind == "HIGH_COUPLING", F.format_string("%s has high external coupling (%.1f dependencies per class)", service, number))
        .when(kind == "LOW_COHESION", F.format_string("%s has low internal cohesion (%.1f%%)", service, number * 100))
        .otherwise(F.format_string("%s has %d cross-service dependencies", service, number.cast("long")))
    )


def recommendations(report: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(step, title, number; titles are fixed values): extract the least coupled cluster first, then the least coupled of those that depend on it; then shared types if anything crosses."""
    first = report.orderBy("external_coupling", "cluster_id").limit(1)
    crossing = with_clusters(edges.select("src", "dst"), assignment).where("src_cluster <> dst_cluster")
    users = crossing.join(F.broadcast(first.select(F.col("cluster_id").alias("dst_cluster"))), "dst_cluster", "left_semi").select(F.col("src_cluster").alias("cluster_id"))
    second = report.join(users.distinct(), "cluster_id", "left_semi").orderBy("external_coupling", "cluster_id").limit(1)
    row = lambda df, step, title: df.select(F.lit(step).alias("step"), title.alias("title"), F.col("external_coupling").alias("number"))
    shared = crossing.limit(1).select(F.lit(3).alias("step"), F.lit("Create shared DTOs").alias("title"), F.lit(None).cast("double").alias("number"))
    return (
        row(first, 1, F.concat(F.lit("Start with "), F.col("name")))
        .unionByName(row(second, 2, F.concat(F.lit("Extract "), F.col("name"), F.lit(" second"))))
        .unionByName(shared)
    )


def pair_priority(boundary: DataFrame) -> DataFrame:
    """(from_service, to_service, calls, priority, first_class): pairs of services; more than three calls are of high priority."""
    pairs = boundary.groupBy("from_service", "to_service").agg(F.count("*").alias("calls"), F.min("from_class").alias("first_class"))
    return pairs.withColumn("priority", F.when(F.col("calls") > 3, "HIGH").otherwise("MEDIUM"))


def first_calls(boundary: DataFrame) -> DataFrame:
    """(from_service, to_service, from_class, to_class, method, calls, priority): each pair's first boundary edge, by seq where there is one; its type stands for a method that is not named."""
    place = F.struct(*(["seq"] if "seq" in boundary.columns else []), "from_class", "to_class")
    first = F.min_by(F.struct("from_class", "to_class", F.coalesce("method", "edge_type").alias("method")), place)
    pairs = boundary.groupBy("from_service", "to_service").agg(first.alias("f"), F.count("*").alias("calls"))
    return pairs.select("from_service", "to_service", "f.*", "calls", F.when(F.col("calls") > 3, "HIGH").otherwise("MEDIUM").alias("priority"))


def called_methods(boundary: DataFrame) -> DataFrame:
    """(to_service, methods): what is called of each service, nulls left out."""
    return boundary.groupBy("to_service").agg(F.array_sort(F.collect_list("method")).alias("methods"))


def package_groups(nodes: DataFrame) -> DataFrame:
    """(package, type, n): what the fallback proposal knows of each package."""
    return nodes.groupBy("package", "type").agg(F.count("*").alias("n"))


def package_proposal(nodes: DataFrame) -> DataFrame:
    """(id, cluster_id): one service for each package, numbered by its first node; the proposal made without a language model."""
    from .merge import sequential_ids

    numbered = sequential_ids(nodes.groupBy("package").agg(F.min("node_seq").alias("s")), ["s", "package"], "cluster_id")
    return nodes.join(numbered, nodes["package"].eqNullSafe(numbered["package"])).select("id", "cluster_id")


#: Fixed value: the one service of a proposal that could not be read.
FALLBACK_SERVICE = "monolith-service"


def readable_proposal(nodes: DataFrame, services: DataFrame) -> DataFrame:
    """services (service_index, name, classes array); if there are none, one service. Its classes come as blocks of rows, not as one list."""
    if not services.isEmpty():
        return services.select("service_index", "name", "classes")
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-nodes.count() // CLASSES))))
    blocks = nodes.groupBy(block.alias("_b")).agg(F.collect_list("id").alias("classes"))
    return blocks.select(F.lit(0).cast("long").alias("service_index"), F.lit(FALLBACK_SERVICE).alias("name"), "classes")


#: Classes in a row of the fallback proposal, about.
CLASSES = 10_000


def proposal_assignment(nodes: DataFrame, services: DataFrame) -> DataFrame:
    """services (service_index, classes) -> (id, cluster_id): the last service that names a class has it; unnamed nodes get ids of their own."""
    named = services.select("service_index", F.explode("classes").alias("id")).groupBy("id").agg(F.max("service_index").cast("long").alias("cluster_id"))
    return with_leftovers(nodes, named)


def with_leftovers(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """assignment, and for every other node a cluster of its own after the largest id."""
    from .merge import sequential_ids

    top = assignment.agg(F.max("cluster_id").alias("m")).first()["m"]
    left = nodes.select("id", "node_seq").join(assignment.select("id"), "id", "left_anti")
    own = sequential_ids(left, ["node_seq", "id"], "cluster_id", 0 if top is None else top + 1)
    return assignment.select("id", F.col("cluster_id").cast("long")).unionByName(own.select("id", F.col("cluster_id").cast("long")))


def chunks(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """rows with the number of their chunk."""
    from .merge import sequential_ids

    return sequential_ids(rows, order, "_i").withColumn("chunk", F.floor(F.col("_i") / size).cast("long")).drop("_i")


