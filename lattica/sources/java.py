"""Scanning source trees into class records, nodes and raw edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import complexity, ignored, is_library, node_type
from ..operators.merge import dependency_edges, keep_last, merge_edges, sequential_ids, with_placeholders
from .javaparse import SCHEMA, parse


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, suffix: str = "*.java", strict: bool = False) -> DataFrame:
    """(file_path, content_hash, source) of every source file below root; ignored paths are dropped before their contents are read as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    kept = files.where(~ignored(F.col("path"), ignore or [], strict))
    return kept.select(F.col("path").alias("file_path"), F.md5("content").alias("content_hash"), F.col("content").cast("string").alias("source"))


def classes(sources: DataFrame) -> DataFrame:
    """A row for each file: parsed is false, and the rest null, where the file holds no class or interface that can be read."""

    def run(batches):
        for b in batches:
            rows = [parse(s or "", p) for p, s in zip(b.file_path, b.source)]
            out = pd.DataFrame([r or {} for r in rows], columns=[f.split(" ", 1)[0] for f in _fields()])
            out["file_path"] = b.file_path.to_numpy()
            out["parsed"] = [r is not None for r in rows]
            yield out.astype(object).where(out.notna(), None)

    return sources.select("file_path", "source").mapInPandas(run, SCHEMA + ", parsed boolean")


def _fields() -> list[str]:
    depth, out, at = 0, [], 0
    for i, c in enumerate(SCHEMA):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(SCHEMA[at:i].strip())
            at = i + 1
    return [*out, SCHEMA[at:].strip()]


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT parsed").select("file_path")


def class_nodes(parsed: DataFrame) -> DataFrame:
    """Nodes of parsed classes, in order of their files; a name twice keeps the last record."""
    numbered = sequential_ids(parsed.where("parsed"), ["file_path"], "node_seq")
    nodes = numbered.select(
        F.col("node_seq").cast("long").alias("node_seq"), F.col("fully_qualified_name").alias("id"), node_type(F.col("annotations"), F.col("simple_name")).alias("type"),
        complexity(F.col("methods"), F.col("fields")).alias("complexity_score"), "file_path", F.col("package_name").alias("package"), "simple_name", "is_interface", "is_abstract",
        "annotations", F.array_size("methods").alias("method_count"), F.array_size("fields").alias("field_count"), "superclass", "fields",
    )
    return keep_last(nodes)


def class_edges(parsed: DataFrame) -> DataFrame:
    """Merged edges of the parsed classes' dependencies, with their places."""
    numbered = sequential_ids(parsed.where("parsed"), ["file_path"], "node_seq")
    return merge_edges(dependency_edges(numbered).where(~is_library(F.col("dst"))), place=True)


def graph_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with placeholders, edges)."""
    edges = class_edges(parsed)
    return with_placeholders(class_nodes(parsed), edges), edges
