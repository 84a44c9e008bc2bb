"""Helpers that the corpus operators share: shared scratch tables, word patterns, weighted quantiles."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

# Executors need no installed copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["lattica.llm"])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for models that are costly to load."""
    module = sys.modules.setdefault("_lattica_worker_cache", types.ModuleType("_lattica_worker_cache"))
    return module.__dict__.setdefault("items_by_name", {})


def tidy() -> None:
    """Give freed memory back to the system: Python workers stay for the next task, and so would what their allocators keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """A function for mapInArrow that tidies up when its partition ends."""

    def then_tidy(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return then_tidy


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or in local mode a temporary folder if unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cache = worker_cache()
        base = cache.get("scratch") or cache.setdefault("scratch", "file://" + tempfile.mkdtemp(prefix="lattica-"))
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    # Texts have no bounded length: few of them at a time go to Python workers.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(min(int(before), 1024) if int(before) > 0 else 1024))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def unit_hash(*cols: Column) -> Column:
    """A repeatable hash of the columns, uniform over 0 .. 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def integer_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of numbers held by the driver, as SQL literals."""
    values = ", ".join("(" + ", ".join(f"{v}L" if isinstance(v, int) else f"{v!r}D" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def weighted_splits(
    rows: DataFrame, group: str, key: str, weight: str, goals: dict[int, float], buckets: int = 1024, tolerance: float = 1e-6, rounds: int = 8
) -> dict[int, int]:
    """For each group in goals a key k such that the group's rows with a key < k weigh as nearly goals[group] as whole keys allow.

    rows: group (integer), key (long, >= 0), weight (numeric, >= 0). Exact to one distinct key, or to ``tolerance`` of the group's weight.
    Each round sums the weights in ``buckets`` equal parts of what is left of each group's key range, so the driver gets
    one row for each group and round, whatever the number of rows; the caller bounds the number of groups.
    Rows with equal keys stay together.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(key).cast("long").alias("k"), F.col(weight).cast("double").alias("w")).where("g IS NOT NULL AND k IS NOT NULL")
    stats = {r.g: (r.lo, r.hi, r.w) for r in rows.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("w").alias("w")).collect()} if goals else {}
    out: dict[int, int] = {}
    left: dict[int, tuple[int, int, float]] = {}  # group: key range that holds the split, weight below it
    for g, goal in goals.items():
        lo, hi, w = stats.get(g, (0, 0, 0.0))
        if goal <= 0 or goal >= w:
            out[g] = lo if goal <= 0 else hi + 1
        else:
            left[g] = (lo, hi, 0.0)
    for _ in range(rounds):
        if not left:
            break
        parts = integer_table(spark, ["g", "lo", "hi", "width", "goal"], [(g, lo, hi, -(-(hi - lo + 1) // buckets), float(goals[g] - below)) for g, (lo, hi, below) in left.items()])
        bins = (
            rows.join(F.broadcast(parts), "g").where("k BETWEEN lo AND hi")
            .groupBy("g", "goal", F.expr("(k - lo) div width AS b")).agg(F.sum("w").alias("w"), F.min("k").alias("first"), F.max("k").alias("last"))
        )
        upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        reached = bins.withColumn("upto", F.sum("w").over(upto)).where("upto >= goal").groupBy("g").agg(F.min_by(F.struct("w", "first", "last", "upto"), "b").alias("x")).collect()
        found = {r.g: r.x for r in reached}
        for g, (lo, hi, below) in list(left.items()):
            x = found.get(g)
            if x is None:  # the parts' sums round to just below the goal
                out[g] = hi + 1
            elif x["first"] == x["last"] or x["w"] <= tolerance * stats[g][2]:
                # One key, or too little to matter: in or out, whichever comes nearer.
                with_it = below + x["upto"]
                out[g] = x["last"] + 1 if with_it - goals[g] <= goals[g] - (with_it - x["w"]) else x["first"]
            else:
                left[g] = (x["first"], x["last"], below + x["upto"] - x["w"])
                continue
            del left[g]
    return out | {g: lo for g, (lo, _, _) in left.items()}
