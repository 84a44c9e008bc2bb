"""Column expressions and small operators that take facts out of semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import cases

#: Relation kinds and the patterns of (target, field).
RELATIONS = {
    "OneToMany": r"@OneToMany.*?private\s+\w+<(\w+)>\s+(\w+)",
    "ManyToOne": r"@ManyToOne.*?private\s+(\w+)\s+(\w+)",
    "OneToOne": r"@OneToOne.*?private\s+(\w+)\s+(\w+)",
    "ManyToMany": r"@ManyToMany.*?private\s+\w+<(\w+)>\s+(\w+)",
}
#: How a mapping annotation names its HTTP method.
MAPPINGS = {"GetMapping": "get", "PostMapping": "post", "PutMapping": "put", "DeleteMapping": "delete", "PatchMapping": "patch"}
#: Context lengths in tokens.
CONTEXT_LIMITS = {
    "gpt-4o": 128_000,
    "gpt-4o-mini": 128_000,
    "gpt-4": 8_192,
    "gpt-4-turbo": 128_000,
    "claude-3-5-sonnet": 200_000,
    "claude-3-opus": 200_000,
    "grok-4-1": 128_000,
    "grok-4-1-fast": 2_000_000,
    "grok-4-1-fast-reasoning": 2_000_000,
    "deepseek-chat": 128_000,
    "deepseek-reasoner": 128_000,
}
DEFAULT_CONTEXT, RESERVED = 128_000, 4_000


def relationships(sources: DataFrame, id_col: str = "id", text: str = "source") -> DataFrame:
    """(id, relation, pos, target, field): annotated relations of each source, kind by kind."""
    out = None
    body = F.coalesce(text, F.lit(""))
    for kind, pattern in RELATIONS.items():
        target, name = (F.regexp_extract_all(body, F.lit("(?s)" + pattern), F.lit(g)) for g in (1, 2))
        found = sources.select(F.col(id_col).alias("id"), target.alias("t"), name.alias("f"))
        part = found.select("id", F.lit(kind).alias("relation"), F.posexplode(F.arrays_zip("t", "f")).alias("pos", "x")).select("id", "relation", "pos", F.col("x.t").alias("target"), F.col("x.f").alias("field"))
        out = part if out is None else out.unionByName(part)
    return out


def links(pages: DataFrame, id_col: str = "page_id", text: str = "html") -> DataFrame:
    """(id, pos, href): every href of a page."""
    return pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "href"))


def base_path(source: Column) -> Column:
    return F.regexp_extract(F.coalesce(source, F.lit("")), r'@RequestMapping\s*\(\s*"([^"]+)"', 1)


def tool_calls(replies: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, pos, name, call): calls in a reply that are valid JSON objects with a name; call is the JSON text."""
    # Fixed value: how a reply marks a call.
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    rows = replies.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "call"))
    return rows.where(F.try_parse_json("call").isNotNull()).withColumn("name", F.get_json_object("call", "$.name")).where("name IS NOT NULL").select("id", "pos", "name", "call")


def compile_errors(logs: DataFrame, id_col: str = "id", text: str = "output") -> DataFrame:
    """(id, pos, file_path, line, column, message) of a build log; the plainer pattern serves only logs without a full match."""
    log = F.coalesce(F.col(text), F.lit(""))
    # The patterns of a build log's errors.
    full = r"(?s)\[ERROR\]\s+([^:]+):?\[(\d+),(\d+)\]\s*(?:error:\s*)?(.*?)(?=\[ERROR\]|\[INFO\]|$)"
    plain = r"\[ERROR\].*?\.java:\[(\d+),(\d+)\]\s*(.*)"
    part = lambda p, g: F.regexp_extract_all(log, F.lit(p), F.lit(g))
    rows = logs.select(F.col(id_col).alias("id"), *[part(full, g).alias(f"f{g}") for g in (1, 2, 3, 4)], *[part(plain, g).alias(f"p{g}") for g in (1, 2, 3)])
    clean = lambda m: F.substring(F.regexp_replace(F.trim(m), r"\s+", " "), 1, 200)
    fulls = F.transform(F.arrays_zip("f1", "f2", "f3", "f4"), lambda x: F.struct(F.trim(x["f1"]).alias("file_path"), x["f2"].cast("int").alias("line"), x["f3"].cast("int").alias("column"), clean(x["f4"]).alias("message")))
    plains = F.transform(F.arrays_zip("p1", "p2", "p3"), lambda x: F.struct(F.lit("unknown").alias("file_path"), x["p1"].cast("int").alias("line"), x["p2"].cast("int").alias("column"), F.substring(F.trim(x["p3"]), 1, 200).alias("message")))
    return rows.select("id", F.posexplode(F.when(F.size("f1") > 0, fulls).otherwise(plains)).alias("pos", "e")).select("id", "pos", "e.*")


def fenced(text: Column, *languages: str) -> Column:
    """The first fenced block of one of the languages (or of none), stripped; without one the whole text without fences."""
    t = F.coalesce(text, F.lit(""))
    kinds = f"(?:{'|'.join(languages)})?" if languages else ""
    pattern = rf"(?is)```{kinds}\s+(.*?)```"
    whole = F.regexp_replace(F.replace(t, F.lit("```"), F.lit("")), r"^\s+|\s+$", "")
    block = F.regexp_replace(F.regexp_extract(t, pattern, 1), r"^\s+|\s+$", "")
    return F.when(t.rlike(pattern), block).otherwise(whole)


def fixed_files(replies: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, pos, file, body): files that a reply gives as a heading and a fence."""
    # Fixed value: how a reply marks a file.
    pattern = r"(?s)### FIXED:\s*(\S+)\s*```\w*\s*(.*?)```"
    t = F.coalesce(F.col(text), F.lit(""))
    zipped = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("file"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("body"))
    return replies.select(F.col(id_col).alias("id"), F.posexplode(zipped).alias("pos", "x")).select("id", "pos", "x.file", F.regexp_replace("x.body", r"^\s+|\s+$", "").alias("body"))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The parsed JSON, or the default where it cannot be parsed."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).otherwise(default)


def service_port(config: Column, default: int = 8080) -> Column:
    # Fixed value: the pattern of a port.
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(config, F.lit("")), r"port:\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(default))


def host_ports(entries: DataFrame) -> DataFrame:
    """(port) sorted and distinct, of entries (short string, published string): "a:b" gives a, the long form what it publishes; digits only."""
    port = F.coalesce("published", F.when(F.instr("short", ":") > 0, F.element_at(F.split("short", ":"), -2)))
    return entries.select(F.trim(port).alias("p")).where(F.col("p").rlike(r"^\d+$")).select(F.col("p").cast("int").alias("port")).distinct().orderBy("port")


def invalid_services(services: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, name): expected services that are missing, and dependencies that no service provides. services (name, depends_on array)."""
    missing = expected.select("name").distinct().join(services.select("name"), "name", "left_anti").select(F.lit("missing").alias("problem"), "name")
    needed = services.select(F.explode("depends_on").alias("name")).distinct().join(services.select("name"), "name", "left_anti")
    return missing.unionByName(needed.select(F.lit("undefined_dependency").alias("problem"), "name"))


def health(status_lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, healthy) for each expected service: the status lines are JSON with Service, State and Health; a missing one is not healthy."""
    s = status_lines.select(F.from_json("line", "Service string, State string, Health string").alias("s")).select("s.*")
    good = (F.lower("State") == "running") & (F.lower(F.coalesce("Health", F.lit(""))).isin("healthy", ""))
    per = s.groupBy(F.col("Service").alias("name")).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("healthy"))
    return expected.select("name").distinct().join(per, "name", "left").select("name", F.coalesce("healthy", F.lit(False)).alias("healthy"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def context_limit(model: Column) -> Column:
    return cases([(model == k, v) for k, v in CONTEXT_LIMITS.items()], F.lit(DEFAULT_CONTEXT))


def fits(tokens: Column, limit: Column, reserve: int = RESERVED, buffer: float = 0.1) -> Column:
    return tokens <= F.floor((limit - reserve) * (1 - buffer))


def utilization(tokens: Column, limit: Column, reserve: int = RESERVED) -> Column:
    return F.bround(tokens / (limit - reserve) * 100, 1)


def shortened(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def annotation_value(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def endpoints(controllers: DataFrame) -> DataFrame:
    """(id, pos, path, http_method, name, parameters, returns) of controllers (id, base, methods array of struct with mapping, suffix, name, return_type, parameters)."""
    m = controllers.select("id", F.coalesce("base", F.lit("")).alias("base"), F.posexplode("methods").alias("pos", "m"))
    verb = cases([(F.col("m.mapping") == k, v) for k, v in MAPPINGS.items()], F.lit(None).cast("string"))
    raw = F.concat("base", F.coalesce("m.suffix", F.lit("")))
    path = F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(F.lit("/"), raw))
    return m.withColumn("http_method", verb).where("http_method IS NOT NULL").select("id", "pos", path.alias("path"), "http_method", F.col("m.name").alias("name"), F.col("m.parameters").alias("parameters"), F.col("m.return_type").alias("returns"))


def openapi_paths(points: DataFrame, order: DataFrame) -> DataFrame:
    """(path, operations map) of all controllers: a later controller's path replaces an earlier one's whole. order (id, seq)."""
    ranked = points.join(order, "id")
    last = ranked.groupBy("path").agg(F.max("seq").alias("seq"))
    kept = ranked.join(last, ["path", "seq"])
    return kept.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("http_method", "name")))).alias("operations"))
