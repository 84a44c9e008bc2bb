"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="lattica-graph-"))
        base = _local[0]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, records: int | None = None) -> DataFrame:
    """Write df and read it back: its lineage ends there. The files go when the driver's JVM ends. records: rows that go to Python at a time, at most."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lattica-graph-{name}-{uuid.uuid4().hex}"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    if records:
        spark.conf.set(batch, str(records))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
