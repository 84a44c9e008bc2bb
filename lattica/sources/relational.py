"""The relational tables as a dependency graph: rows are nodes named <table>:<key>, references are edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reads a table of a folder on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def node(table: str, key: Column) -> Column:
    return F.concat(F.lit(table + ":"), key.cast("string"))


#: Table, key, type, complexity, label, rank of the table in node_seq.
KINDS = [
    ("region", "r_regionkey", "Controller", "0", "r_name", 0),
    ("nation", "n_nationkey", "Service", "n_nationkey", "n_name", 1),
    ("customer", "c_custkey", "Entity", "0", "c_name", 2),
    ("supplier", "s_suppkey", "Entity", "0", "s_name", 3),
    ("part", "p_partkey", "Entity", "p_size", "p_name", 4),
    ("orders", "o_orderkey", "Repository", "0", "o_orderpriority", 5),
]
#: Keys of one table come before those of the next one.
STEP = 10_000_000_000_000


def nodes(t: Tables, *tables: str) -> DataFrame:
    """(node_seq, id, type, complexity_score, package, simple_name); all tables or those named."""
    out = None
    for table, key, kind, score, label, rank in KINDS:
        if tables and table not in tables:
            continue
        rows = getattr(t, table).select(
            (F.lit(rank * STEP) + F.col(key)).alias("node_seq"), node(table, F.col(key)).alias("id"), F.lit(kind).alias("type"),
            F.expr(score).cast("long").alias("complexity_score"), F.lit(table).alias("package"), F.col(label).alias("simple_name"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def raw_edges(t: Tables, *kinds: str) -> DataFrame:
    """(seq, src, dst, type, weight, method_name): references; suppliers to parts once for each line item, typed by its return flag."""
    from ..operators.merge import type_weight

    def refer(table: DataFrame, src: Column, dst: Column, kind: str, seq: Column) -> DataFrame:
        return table.select(seq.cast("string").alias("seq"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    made = {
        "nation": lambda: refer(t.nation, node("nation", F.col("n_nationkey")), node("region", F.col("n_regionkey")), "INHERITS", pad(F.col("n_nationkey"))),
        "customer": lambda: refer(t.customer, node("customer", F.col("c_custkey")), node("nation", F.col("c_nationkey")), "INHERITS", pad(F.col("c_custkey"))),
        "supplier": lambda: refer(t.supplier, node("supplier", F.col("s_suppkey")), node("nation", F.col("s_nationkey")), "INHERITS", pad(F.col("s_suppkey"))),
        "orders": lambda: refer(t.orders, node("orders", F.col("o_orderkey")), node("customer", F.col("o_custkey")), "CALLS", pad(F.col("o_orderkey"))),
        "lineitem": lambda: t.lineitem.select(
            F.concat(F.date_format("l_shipdate", "yyyyMMdd"), pad(F.col("l_orderkey")), pad(F.col("l_linenumber")), F.col("l_returnflag")).alias("seq"),
            node("supplier", F.col("l_suppkey")).alias("src"), node("part", F.col("l_partkey")).alias("dst"),
            F.when(F.col("l_returnflag") == "A", "IMPORTS").when(F.col("l_returnflag") == "N", "CALLS").otherwise("INHERITS").alias("type"),
        ),
    }
    out = None
    for name in kinds or made:
        rows = made[name]()
        out = rows if out is None else out.unionByName(rows)
    return out.select("seq", "src", "dst", "type", type_weight(F.col("type")).alias("weight"), F.lit(None).cast("string").alias("method_name"))


def assignment(t: Tables) -> DataFrame:
    """(id, cluster_id): regions of nations, customers and suppliers, of orders through their customers; parts by size modulo 5."""
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("cluster_id"))
    customer = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cluster_id")
    return (
        t.region.select(node("region", F.col("r_regionkey")).alias("id"), F.col("r_regionkey").cast("long").alias("cluster_id"))
        .unionByName(nation.select(node("nation", F.col("n_nationkey")).alias("id"), "cluster_id"))
        .unionByName(customer.select(node("customer", F.col("c_custkey")).alias("id"), "cluster_id"))
        .unionByName(t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(node("supplier", F.col("s_suppkey")).alias("id"), "cluster_id"))
        .unionByName(t.part.select(node("part", F.col("p_partkey")).alias("id"), (F.col("p_size") % 5).cast("long").alias("cluster_id")))
        .unionByName(t.orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(node("orders", F.col("o_orderkey")).alias("id"), "cluster_id"))
    )
