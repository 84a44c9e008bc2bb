"""API documents of controllers and entities, and checks of generated sources."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import api_type, last_part
from ..operators.hierarchy import schemas
from ..sources.documents import lines, listed, quoted, union


def _ref(name: Column) -> Column:
    return F.concat(F.lit("#/components/schemas/"), name)


def operations(points: DataFrame) -> DataFrame:
    """(id, path, http_method, operation) of endpoints whose parameters have type, name, annotations: operation is its JSON text.

    Path variables and request parameters become parameters, the last request body the body; a list's items or the type itself is the response.
    """
    marked = lambda p, mark: F.array_contains(p["annotations"], mark)
    kept = F.filter("parameters", lambda p: marked(p, "PathVariable") | marked(p, "RequestParam"))
    params = F.transform(kept, lambda p: F.struct(
        p["name"].alias("name"), F.when(marked(p, "PathVariable"), "path").otherwise("query").alias("in"), F.lit(True).alias("required"), F.struct(api_type(p["type"]).alias("type")).alias("schema")
    ))
    bodies = F.filter("parameters", lambda p: ~marked(p, "PathVariable") & ~marked(p, "RequestParam") & marked(p, "RequestBody"))
    body_type = F.split(last_part(F.try_element_at(bodies, F.lit(-1))["type"]), "<")[0]
    returns = F.coalesce("returns", F.lit("void"))
    item = last_part(F.trim(F.split(F.element_at(F.split(returns, "<"), -1), ">")[0]))
    void, many = F.lower(returns).isin("void", "none"), F.lower(returns).rlike("list|collection")
    schema = F.when(void, F.lit("{}")).when(many, F.to_json(F.struct(F.lit("array").alias("type"), F.struct(_ref(item).alias("$ref")).alias("items")))).otherwise(F.to_json(F.struct(_ref(last_part(returns)).alias("$ref"))))
    body = F.when(body_type.isNotNull(), F.concat(F.lit(',"requestBody":{"required":true,"content":{"application/json":{"schema":'), F.to_json(F.struct(_ref(body_type).alias("$ref"))), F.lit("}}}")))
    text = F.concat(F.lit('{"operationId":'), quoted(F.col("name")), F.lit(',"parameters":'), F.to_json(params), F.coalesce(body, F.lit("")), F.lit(',"responses":{"200":{"description":"OK","content":{"application/json":{"schema":'), schema, F.lit("}}}}}"))
    return points.select("id", "path", "http_method", text.alias("operation"))


def paths(ops: DataFrame, order: DataFrame, *by: str) -> DataFrame:
    """(path, verbs): JSON of each path's operations; of a path that two controllers have, the later one's (order: id, seq) counts whole. With ``by`` (columns of order) for each of its values."""
    keys = [*by, "path"]
    ranked = ops.join(order.select("id", "seq", *by), "id")
    kept = ranked.join(ranked.groupBy(*keys).agg(F.max("seq").alias("seq")), [*keys, "seq"])
    one = kept.groupBy(*keys, "http_method").agg(F.min("operation").alias("operation"))
    entry = F.concat(quoted(F.col("http_method")), F.lit(":"), F.col("operation"))
    return one.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("verbs"))


def entity_schemas(classes: DataFrame) -> DataFrame:
    """(id, name, schema): JSON of each entity."""
    rows = schemas(classes).join(classes.select("id", F.col("simple_name").alias("entity")), "id")
    prop = F.struct("pos", F.concat(quoted(F.col("name")), F.lit(':{"type":'), quoted(F.col("api_type")), F.lit("}")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(prop)), lambda p: p["t"]), ",")
    return rows.groupBy("id", "entity").agg(F.concat(F.lit('{"type":"object","properties":{'), body, F.lit("}}")).alias("schema")).select("id", F.col("entity").alias("name"), "schema")


def schema_rows(classes: DataFrame) -> DataFrame:
    """(name, schema): JSON of each entity."""
    return entity_schemas(classes).select("name", "schema")


def document_parts(points: DataFrame, entities: DataFrame, assignment: DataFrame, order: DataFrame) -> DataFrame:
    """(cluster_id, part, key, value): the paths and schemas of each service's document, a row for each, so that no service is gathered.

    points as operations takes them, entities (id, name, schema), order (id, seq) of controllers. Of entities with one name in a service the first by id counts.
    """
    placed = order.join(assignment.select("id", "cluster_id"), "id")
    found = paths(operations(points), placed, "cluster_id").select("cluster_id", F.lit("paths").alias("part"), F.col("path").alias("key"), F.col("verbs").alias("value"))
    named = entities.join(assignment.select("id", "cluster_id"), "id").groupBy("cluster_id", "name").agg(F.min_by("schema", "id").alias("value"))
    return found.unionByName(named.select("cluster_id", F.lit("schemas").alias("part"), F.col("name").alias("key"), "value"))


def documents_of(names: DataFrame, parts: DataFrame, folder: str = "services") -> DataFrame:
    """The lines of every service's document, of names (cluster_id, name) and parts as of document_parts: JSON, which is YAML as well."""
    file = F.concat(F.lit(f"{folder}/"), F.col("name"), F.lit("/openapi.yaml"))
    head = F.concat(F.lit('{"openapi": "3.0.0", "info": {"title": '), quoted(F.col("name")), F.lit(', "version": "1.0.0"}, "paths": {'))
    own = parts.join(names, "cluster_id")
    entry = lambda part, section: listed(lines(own.where(F.col("part") == part), file, section, F.concat(quoted(F.col("key")), F.lit(": "), F.col("value")), c=F.col("key")))
    return union(lines(names, file, 0, head), entry("paths", 1), lines(names, file, 2, F.lit('}, "components": {"schemas": {')), entry("schemas", 3), lines(names, file, 4, F.lit("}}}")))


def document_lines(title: str, parts: Iterable[tuple[str, str, str]]) -> Iterator[str]:
    """The document of one service, line by line, of its (part, key, value) in order, for a caller that holds them; whole runs use :func:`documents_of`."""
    yield '{"openapi": "3.0.0", "info": ' + json.dumps({"title": title, "version": "1.0.0"}) + ', "paths": {'
    open_part, comma = "paths", ""
    for part, key, value in parts:
        if part != open_part:
            open_part, comma = part, ""
            yield '}, "components": {"schemas": {'
        yield f"{comma}{json.dumps(key)}: {value}"
        comma = ","
    yield "}}}" if open_part == "schemas" else '}, "components": {"schemas": {}}}'


def document(title: str, path_rows: DataFrame, schemas_: DataFrame) -> str:
    """The document of one service as a string, for display."""
    listed = lambda df, key, value: {r[key]: json.loads(r[value]) for r in df.orderBy(key).toLocalIterator()}
    return json.dumps({"openapi": "3.0.0", "info": {"title": title, "version": "1.0.0"}, "paths": listed(path_rows, "path", "verbs"), "components": {"schemas": listed(schemas_, "name", "schema")}}, indent=2)


def missing_components(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, name, problem) of expected (kind, name) without a file (stem, source), and of controllers whose class body is empty."""
    found = files.groupBy(F.col("stem").alias("name")).agg(F.max("source").alias("source"))
    e = expected.join(found, "name", "left")
    body = F.regexp_extract("source", r"(?s)public\s+class\s+\w+[^{]*\{(.*)\}", 1)
    empty = (F.col("kind") == "Controller") & F.col("source").rlike(r"(?s)public\s+class\s+\w+[^{]*\{.*\}") & body.rlike(r"^\s*$")
    return e.select("kind", "name", F.when(F.col("source").isNull(), "missing").when(empty, "empty body").alias("problem")).where("problem IS NOT NULL")


def as_blocks(files: DataFrame) -> DataFrame:
    """One row per service: its files (service, name, source) as fenced blocks, in order of name."""
    kind = F.element_at(F.split("name", r"\."), -1)
    fence = F.when(kind.isin("yml", "yaml"), "yaml").otherwise(kind)
    block = F.concat(F.lit("### "), F.col("name"), F.lit("\n```"), fence, F.lit("\n"), F.coalesce("source", F.lit("")), F.lit("\n```"))
    return files.groupBy("service").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))


#: States of a generated service, in order.
STATES = ["pending", "compiled", "docker_built", "healthy", "approved"]


def latest_states(transitions: DataFrame) -> DataFrame:
    """(service, state, iterations): the farthest state of each service of transitions (service, seq, state); unknown states don't count."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    t = transitions.withColumn("rank", rank).where("rank > 0")
    return t.groupBy("service").agg(F.max_by("state", F.struct("rank", "seq")).alias("state"), F.count("*").alias("iterations"))


def service_calls(boundary: DataFrame, members: DataFrame) -> DataFrame:
    """The boundary edges that leave a service's own classes (id)."""
    return boundary.join(members.select(F.col("id").alias("from_class")).distinct(), "from_class", "left_semi")


def shared_cluster(report: DataFrame, names: tuple[str, ...] = ("shared-service", "common-service", "shared")) -> DataFrame:
    """The first cluster with a shared name; none or one row."""
    return report.where(F.col("name").isin(*names)).orderBy("cluster_id").limit(1)
