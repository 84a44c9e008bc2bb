"""Node and edge tables: merging raw edges, placeholders, counts, neighbours, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of one dependency of each type; other types weigh 1.
TYPE_WEIGHT = {"INHERITS": 10.0, "IMPORTS": 1.0, "CALLS": 5.0}


def type_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, w in TYPE_WEIGHT.items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out


def merge_edges(raw: DataFrame, place: bool = False) -> DataFrame:
    """raw (seq, src, dst, type, weight, method_name) -> one row for each (src, dst); with place also seq, that of the first raw edge.

    Weights add up; types holds each type once in the order of its first edge; type and method_name are those of the first edge by seq.
    Types are reduced to their first seq before a pair's list is built, so a pair with any number of raw edges keeps a short list.
    """
    by_type = raw.groupBy("src", "dst", "type").agg(
        F.sum("weight").alias("w"), F.min("seq").alias("seq"), F.min_by(F.struct("method_name"), "seq").alias("m")
    )
    typed = F.array_sort(F.collect_list(F.struct("seq", "type")))
    return by_type.groupBy("src", "dst").agg(
        F.min_by("type", "seq").alias("type"),
        F.sum("w").alias("weight"),
        F.transform(typed, lambda x: x["type"]).alias("types"),
        F.min_by("m", "seq")["method_name"].alias("method_name"),
        *([F.min("seq").alias("seq")] if place else []),
    )


def dependency_edges(classes: DataFrame) -> DataFrame:
    """Raw edges of parsed classes (node_seq, fully_qualified_name, dependencies): one for each dependency, weighed by type."""
    each = classes.select("node_seq", F.col("fully_qualified_name").alias("src"), F.posexplode("dependencies").alias("pos", "d"))
    return each.select(
        (F.col("node_seq") * 1_000_000 + F.col("pos")).alias("seq"), "src", F.col("d.target_class").alias("dst"),
        F.col("d.dependency_type").alias("type"), type_weight(F.col("d.dependency_type")).alias("weight"), F.col("d.method_name").alias("method_name"),
    )


def keep_last(nodes: DataFrame) -> DataFrame:
    """Of nodes with one id the last by node_seq, at the place of the first."""
    whole = F.struct(*[c for c in nodes.columns if c not in ("id", "node_seq")])
    latest = nodes.groupBy("id").agg(F.min("node_seq").alias("node_seq"), F.max_by(whole, "node_seq").alias("n"))
    return latest.select("node_seq", "id", "n.*").select(*nodes.columns)


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and, of type Unknown, every end of an edge that is no node."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id IS NOT NULL").distinct()
    absent = ends.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(absent.withColumn("type", F.lit("Unknown")), allowMissingColumns=True)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node that has an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def dependencies_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()


def dependents_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()


def induced_subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes among ids (a column id) and the edges between them."""
    ids = ids.select("id").distinct()
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    return nodes.join(ids, "id", "left_semi"), edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")


def first_wins_mode(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """For each key the commonest value; of equally common ones the one met first by seq."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("s"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("s"))).alias(value))


def sequential_ids(rows: DataFrame, order: list[str], name: str, start: int = 0, part_rows: int = 50_000) -> DataFrame:
    """rows with gapless numbers in the given order, numbered by range partitions rather than in one task.

    The order must be total. Rows are range-partitioned, numbered within partitions, and shifted by the counts of the partitions before.
    """
    n = rows.count()
    if n <= part_rows:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + start)
    from ..sources.scratch import materialize

    parted = materialize(rows.repartitionByRange(-(-n // part_rows), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_own", own).join(shift, "_part").withColumn(name, F.col("_shift") + F.col("_own") - 1 + start).drop("_part", "_own", "_shift")
