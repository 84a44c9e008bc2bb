"""Hybrid edge weights and constraint contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import cosine

#: Factor of each type of dependency in the structural weight.
TYPE_FACTOR = {"CALLS": 2.0, "INHERITS": 3.0, "IMPORTS": 0.5}


def factors(alpha: float = 0.5, beta: float = 0.2, gamma: float = 0.3) -> tuple[float, float, float]:
    total = alpha + beta + gamma
    return (alpha / total, beta / total, gamma / total) if total > 0 else (alpha, beta, gamma)


def type_factor(types: Column) -> Column:
    """The sum of the types' factors."""
    one = lambda t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_FACTOR.items() for x in kv]), t), F.lit(0.0))
    return F.aggregate(types, F.lit(0.0), lambda acc, t: acc + one(t))


def pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each connected pair (a before b by node_seq): structural weight and the weight of the edge a -> b.

    Driven by the edges; self links have no pair. An edge counts its summed weight once for each of its types.
    """
    seq = lambda side: nodes.select(F.col("id").alias(side), F.col("node_seq").alias(f"{side}_seq"), F.col("type").alias(f"{side}_type"))
    e = edges.where("src <> dst").join(seq("src"), "src").join(seq("dst"), "dst")
    ahead = F.col("src_seq") < F.col("dst_seq")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    e = e.select(
        pick("src", "dst").alias("a"), pick("dst", "src").alias("b"), pick("src_type", "dst_type").alias("a_type"), pick("dst_type", "src_type").alias("b_type"),
        (F.col("weight") * type_factor(F.col("types"))).alias("s"), F.when(ahead, F.col("weight")).alias("forward"),
    )
    out = e.groupBy("a", "b", "a_type", "b_type").agg(F.sum("s").alias("s"), F.max("forward").alias("forward"))
    gravity = (F.col("a_type") == "Entity") & (F.col("b_type") == "Entity") & (F.coalesce("forward", F.lit(0.0)) > 5)
    return out.select("a", "b", F.least(F.col("s") / 10.0, F.lit(1.0)).alias("structural"), F.when(gravity, 1.0).otherwise(0.0).alias("gravity"))


def hybrid_weights(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, alpha: float = 0.5, beta: float = 0.2, gamma: float = 0.3) -> DataFrame:
    """(a, b, weight) of connected pairs: alpha structural + beta semantic + gamma gravity; what is not positive is left out."""
    alpha, beta, gamma = factors(alpha, beta, gamma)
    p = pairs(nodes, edges)
    semantic = F.lit(0.0)
    if vectors is not None:
        for side in ("a", "b"):
            p = p.join(vectors.select(F.col("id").alias(side), F.col("vec").alias(f"{side}_vec")), side, "left")
        semantic = F.coalesce(cosine(F.col("a_vec"), F.col("b_vec")), F.lit(0.0))
    weight = alpha * F.col("structural") + beta * semantic + gamma * F.col("gravity")
    return p.select("a", "b", weight.alias("weight")).where("weight > 0")


def constraint_members(nodes: DataFrame, constraints: list[list[str]] | DataFrame) -> DataFrame:
    """(id, super): the nodes that constraint groups merge. constraints: a list of names for each group, or a table (grp int, pattern string).

    A name with a star is a prefix once its stars are gone, another one is literal. A group counts if it names more than one; literal names count even
    if no node has them. A node in several groups goes to the last.
    Prefixes meet the ids' own beginnings of the lengths that prefixes have, by an equi-join: the plan's size doesn't depend on the number of patterns, and a node has a row for each length at most.
    """
    spark = nodes.sparkSession
    if isinstance(constraints, list):
        constraints = spark.createDataFrame([(g, name) for g, names in enumerate(constraints) for name in names], "grp int, pattern string")
    patterns = constraints.where("grp IS NOT NULL AND pattern IS NOT NULL").select("grp", "pattern").distinct()
    ids, star = nodes.select("id").distinct(), F.col("pattern").contains("*")
    literals = patterns.where(~star).select("grp", F.col("pattern").alias("id"))
    prefixes = patterns.where(star).select("grp", F.replace("pattern", F.lit("*"), F.lit("")).alias("prefix")).distinct()
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # at most as many as the longest pattern has characters
    begins = ids.select("id", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length("id") >= F.col("n"))
    hits = begins.withColumn("prefix", F.expr("substring(id, 1, n)")).join(prefixes, "prefix").select("grp", "id").unionByName(ids.join(literals, "id").select("grp", "id")).distinct()
    absent = literals.join(ids, "id", "left_anti")
    keep = hits.unionByName(absent.select("grp", "id")).groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    return hits.join(keep, "grp", "left_semi").groupBy("id").agg(F.max("grp").alias("grp")).select("id", F.concat(F.lit("super:"), F.col("grp").cast("string")).alias("super"))


def contract(pairs_: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, weight) between super nodes: ends rewritten, links within one dropped, parallel links summed."""
    p = pairs_
    for side in ("a", "b"):
        p = p.join(members.select(F.col("id").alias(side), F.col("super").alias(f"{side}_super")), side, "left").withColumn(side, F.coalesce(f"{side}_super", side)).drop(f"{side}_super")
    p = p.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return p.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def expand(assignment: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster_id) of nodes, of an assignment of super nodes."""
    inside = members.join(assignment.withColumnRenamed("id", "super"), "super").select("id", "cluster_id")
    return assignment.join(members.select(F.col("super").alias("id")).distinct(), "id", "left_anti").unionByName(inside)
