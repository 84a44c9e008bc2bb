"""Incremental batches as a stream: new source files are folded into a stored hash table as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import incremental
from ..sources.buckets import BucketedTable

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, suffix: str = "*.java") -> DataFrame:
    """A stream of (file_path, content_hash, source) of files below root."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    return files.select(F.col("path").alias("file_path"), F.md5("content").alias("content_hash"), F.col("content").cast("string").alias("source"))


def fold_changes(stream: DataFrame, snapshots: incremental.Snapshots, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upserts each batch's hashes into the snapshot's table ``files``; on_change gets the new and changed files of the batch.

    A batch that is run again after a failure finds its files unchanged, so the fold is idempotent. The snapshot's other tables stay: what an analysis has parsed is in its own.
    """

    def batch(df: DataFrame, _: int) -> None:
        latest = df.dropDuplicates(["file_path"]).persist()
        try:
            hashes = latest.select("file_path", "content_hash")
            stored = (snapshots.load() or {}).get("files")
            if stored is None:
                stored = hashes.limit(0)
            changed = incremental.changes(stored, hashes).where("state IN ('new', 'changed')").select("file_path")
            if on_change:
                on_change(latest.join(changed, "file_path", "left_semi"))
            snapshots.save({"files": incremental.upsert(stored, hashes)}, keep=True)
        finally:
            latest.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HASHES = "file_path string, content_hash string"


def hash_table(spark: SparkSession, folder: str, buckets: int = 64) -> BucketedTable:
    """The hashes of files, bucketed by path."""
    return BucketedTable(spark, folder, ["file_path"], HASHES, buckets)


def merge_changes(stream: DataFrame, table: BucketedTable, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """As fold_changes, into a bucketed table: a batch reads and rewrites only the buckets of its own files, and other writers may merge into the table meanwhile."""

    def batch(df: DataFrame, _: int) -> None:
        latest = df.dropDuplicates(["file_path"]).persist()
        try:
            hashes = latest.select("file_path", "content_hash")
            stored = table.read().join(hashes.select("file_path"), "file_path", "left_semi")
            changed = incremental.changes(stored, hashes).where("state IN ('new', 'changed')").select("file_path").persist()
            if on_change:
                on_change(latest.join(changed, "file_path", "left_semi"))
            table.merge(hashes.join(changed, "file_path", "left_semi"))
        finally:
            latest.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
