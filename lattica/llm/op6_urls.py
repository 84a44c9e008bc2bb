"""URL filters as a sort-merge range join, in DataFrame expressions only.

A host becomes a key of its labels in reverse, each ended by a dot (``com.example.www.``), so a rule's host and all its subdomains
are the interval of keys that start with the rule's key. Intervals of that kind are nested or apart: a sweep over the rules' ends in key order
with a stack of open rules cuts the key space into segments, each with the rules that hold in it. The rules are a
parameter, so that sweep is the driver's. Segment starts and the pages' distinct hosts are then sorted together over
range partitions; each host takes the last segment that starts at or before it, in its partition or, at a partition's head, from
the partitions before. Pages join their hosts' rules, and the longest whose path starts theirs decides.

A hot host is one row in the sweep; joining it back is a plain join that Spark may split.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets the default verdict; repeated rows
are judged alike; a rule is as long as its host and path together, and of rules of equal length the one with the longer host, then
the greater text, wins; with no rules every page gets the default; an empty table gives an empty table. Other columns are ignored, and html is never read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = [
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
]


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def segments(rules: list[UrlRule]) -> list[tuple[str, list[UrlRule]]]:
    """(start key, rules that hold from there), in key order; the sweep over the rules' intervals with a stack."""
    by_host: dict[str, list[UrlRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    out: list[tuple[str, list[UrlRule]]] = [("", [])]
    stack: list[tuple[str, list[UrlRule]]] = []  # end of interval, rules of the host

    def put(key: str) -> None:
        held = [r for _, rs in stack for r in rs]
        if out[-1][0] == key:
            out[-1] = (key, held)
        else:
            out.append((key, held))

    for host in sorted(by_host, key=lambda h: key_of(h).encode()):
        key = key_of(host)
        while stack and stack[-1][0].encode() <= key.encode():
            end, _ = stack.pop()
            put(end)
        stack.append((key[:-1] + "/", by_host[host]))  # "/" follows "." and is in no host
        put(key)
    while stack:
        end, _ = stack.pop()
        put(end)
    return out


def _segment_table(spark: SparkSession, cuts: list[tuple[str, list[UrlRule]]]) -> DataFrame:
    rule = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(len(r.host) + len(r.path)).alias("len"), F.lit(len(r.host)).alias("host_len"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    kind = "array<struct<path:string,len:int,host_len:int,rule:string,verdict:string>>"
    rows = [F.struct(F.lit(k).alias("key"), (F.array(*map(rule, held)) if held else F.array()).cast(kind).alias("held")) for k, held in cuts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 2)


def judge(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages."""
    spark = pages.sparkSession
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    cuts = segments(rules)
    starts = _segment_table(spark, cuts).select("key", F.lit(0).alias("is_host"), F.lit(None).cast("string").alias("host"), "held")
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    hosts = seen.select("host").distinct().select(key.alias("key"), F.lit(1).alias("is_host"), "host", F.lit(None).cast(starts.schema["held"].dataType).alias("held"))
    # Range partitions in key order; written, so that both uses below see the same partitions.
    swept = materialize(starts.unionByName(hosts).repartitionByRange("key", "is_host").withColumn("part", F.spark_partition_id()), "hosts")
    so_far = Window.partitionBy("part").orderBy("key", "is_host").rowsBetween(Window.unboundedPreceding, 0)
    local = swept.withColumn("open", F.last("held", ignorenulls=True).over(so_far)).where("is_host = 1")
    # What the earlier partitions end with: a row for each partition.
    ends = swept.groupBy("part").agg(F.max_by("held", F.when(F.col("held").isNotNull(), F.col("key"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    known = materialize(local.join(carried, "part").select("host", F.coalesce("open", "carried").alias("held")), "held")
    fits = F.filter("held", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"], r["host_len"], r["rule"], r["verdict"])))
    judged = seen.join(known, "host", "left").withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the verdict on every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
