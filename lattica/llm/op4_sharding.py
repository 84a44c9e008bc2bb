"""Balanced shards by a k-d tree over document metadata, in DataFrame expressions only.

The tree starts with all documents. A node that must become n shards splits at the weighted quantile n//2 / n of its widest metadata
dimension, widths being measured as shares of the whole table's range; the weight is the document's size. Quantiles are found by
repeated histograms (:func:`weighted_splits`), so each level costs a few aggregations of a narrow table and
the driver sees some rows for each node, never documents. Strings enter by the rank of their whole value among the distinct ones, which range partitions number. A
dimension's equal values are ordered by a hash of the row, so that a value that a third of all rows share splits like any other. Leaves end at the target size.

Defined results: a null or empty text has the size of the overhead; a very long text is one row like any other, so its shard may exceed the target by it; null metadata come first in their dimension; rows that are equal in
every dimension and in their id go to one shard; fewer documents than shards leave shards empty; an empty table gives an empty table.
Columns of the input other than id, text and the dimensions play no part; :func:`write_shards` passes them through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_table, materialize, weighted_splits

#: Bytes counted for each document besides its text.
OVERHEAD = 16
#: A dimension's range is cut into so many steps; finer ties are ordered by the row's hash.
STEPS = (1 << 30) - 1
#: Rows numbered in one task, about.
SLOT_ROWS = 2048


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def _as_number(df: DataFrame, name: str) -> Column:
    """An order-preserving number of a column that is no string; null comes first."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        col = F.unix_seconds(col.cast("timestamp"))
    return F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(-1.0))


def _ranks(docs: DataFrame, name: str) -> DataFrame:
    """(value, rank double, from 0) of the distinct strings of a column, in the order of their UTF-8 bytes."""
    values = docs.select(F.col(f"`{name}`").alias("value")).where("value IS NOT NULL").distinct()
    parted = materialize(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    starts, at = [], 0
    for r in parted.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], at))
        at += r["count"]
    own = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    start = F.broadcast(integer_table(docs.sparkSession, ["part", "start"], starts or [(0, 0)]))
    return materialize(parted.withColumn("own", own).join(start, "part").select("value", (F.col("start") + F.col("own") - 1).cast("double").alias("rank")), "ranks")


def _placed(docs: DataFrame, shards: int | None, target_bytes: int | None, dims: tuple[str, ...], id_col: str, text: str) -> tuple[DataFrame, DataFrame, Column, int]:
    """(rows with the input's columns as a struct ``row``, the same without it, the shard over either's columns, rows in a shard)."""
    dims = tuple(d for d in dims if d in docs.columns)
    names = [f"d{i}" for i in range(len(dims) + 1)]
    strings = {d for d in dims if isinstance(docs.schema[d].dataType, T.StringType)}
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32)

    def key_of(number: Column, lo: float | None, hi: float | None) -> Column:
        step = F.lit(0) if lo is None or hi == lo else (number - lo) * (STEPS / (hi - lo))
        return F.shiftleft(step.cast("long"), 32) + tie

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("doc_id"),
        size_of(F.col(text)).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        *[(F.col(f"`{d}`") if d in strings else _as_number(docs, d)).alias(x) for x, d in zip(names, dims)],
    )
    for x, d in zip(names, dims):
        if d in strings:
            ranks = _ranks(docs, d)
            hi = ranks.agg(F.max("rank")).first()[0]
            lo = None if hi is None else 0.0 if docs.where(F.col(f"`{d}`").isNull()).isEmpty() else -1.0
            rows = rows.join(ranks.withColumnRenamed("value", x), x, "left").withColumn(x, F.coalesce("rank", F.lit(-1.0))).drop("rank")
        else:
            lo, hi = docs.agg(F.min(_as_number(docs, d)), F.max(_as_number(docs, d))).first()  # reads no texts
        rows = rows.withColumn(x, key_of(F.col(x), lo, hi))
    rows = rows.withColumn(names[-1], key_of(F.log2("size"), 4.0, 31.1))  # sizes lie between 2**4 and 2**31
    slim = materialize(rows.select("doc_id", "size", "text_crc32", *names), "sizes")
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))

    # The tree: splits[node] = (dimension, key, left child, right child); a node is (first shard, number of shards).
    splits: dict[tuple[int, int], tuple[str, int]] = {}

    def leaf(node: tuple[int, int]) -> Column:
        """The node, by its first shard, that a row has come to."""
        if node not in splits:
            return F.lit(node[0])
        dim, key = splits[node]
        half = node[1] // 2
        return F.when(F.col(dim) < key, leaf((node[0], half))).otherwise(leaf((node[0] + half, node[1] - half)))

    root = (0, shards)
    level = [root] if shards > 1 and n else []
    while level:
        at = slim.withColumn("node", leaf(root))
        spread = at.groupBy("node").agg(F.sum("size").alias("size"), *[(F.shiftright(F.max(x), 32) - F.shiftright(F.min(x), 32)).alias(x) for x in names]).collect()
        wide = {r["node"]: (max(names, key=lambda x: r[x]), r["size"]) for r in spread}
        level = [n for n in level if n[0] in wide]  # a node without rows needs no split
        key = F.lit(None).cast("long")
        for node in level:
            key = F.when(F.col("node") == node[0], F.col(wide[node[0]][0])).otherwise(key)
        goals = {node[0]: wide[node[0]][1] * (node[1] // 2) / node[1] for node in level}
        found = weighted_splits(at.select("node", key.alias("key"), "size"), "node", "key", "size", goals)
        for node in level:
            splits[node] = (wide[node[0]][0], found[node[0]])
        level = [c for node in level for c in ((node[0], node[1] // 2), (node[0] + node[1] // 2, node[1] - node[1] // 2)) if c[1] > 1]
    return rows, slim, leaf(root).cast("int"), math.ceil(n / shards)


def _part(in_shard: int) -> Column:
    """The small part of its shard that a row is numbered in."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, math.ceil(in_shard / SLOT_ROWS))))


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang", "doc_id"), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row: into ``shards`` shards, or as many as ``target_bytes`` a shard needs.

    The text's size is a dimension too. Sizes of shards differ by about a document.
    """
    _, slim, shard, in_shard = _placed(docs, shards, target_bytes, dims, id_col, text)
    # Gapless numbers: count rows in small parts of each shard, number within a part, add what lies before it.
    placed = slim.select("doc_id", "size", "text_crc32", shard.alias("shard"), _part(in_shard).alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within)).join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang", "doc_id"), id_col: str = "doc_id", text: str = "text") -> None:
    """Write every row of docs as Parquet, a folder ``shard=N`` for each shard, in the order of slots; an input column ``shard`` goes in as ``shard_``."""
    rows, _, shard, in_shard = _placed(docs, shards, target_bytes, dims, id_col, text)
    placed = rows.withColumn("_shard", shard).withColumn("_part", _part(in_shard))
    order = ["_shard", "_part", "doc_id", "text_crc32", "size"]
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    own = [F.col(f"row.`{c}`").alias(c if c.lower() != "shard" else c + "_") for c in docs.columns]
    sorted_.select(*own, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's place among 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return assign(docs, shards=40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
