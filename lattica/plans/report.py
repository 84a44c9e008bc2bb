"""Reports: the plan document, Markdown, sequence diagrams, compose files, final summaries.

Every document is rows of lines (:mod:`lattica.sources.documents`), which executors write.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import simple_name
from ..operators import clusters
from ..sources import jsondoc
from ..sources.documents import lines, listed, quoted, union
from ..sources.scratch import materialize

CLUSTER = (
    "id bigint,suggested_name string,description string,rationale string,classes array<string>,"
    "metrics struct<class_count:bigint,internal_cohesion:double,external_coupling:double,complexity_score:bigint>,dominant_type string,entities array<string>,entry_points array<string>"
)
CALL = "from_service string,to_service string,from_class string,to_class string,method string,edge_type string,weight double,refactoring_required boolean"
#: What each kind of warning suggests.
SUGGESTIONS = {
    "HIGH_COUPLING": "Consider creating shared DTOs or reducing dependencies",
    "LOW_COHESION": "Review if classes in this cluster should be split further",
    "MANY_BOUNDARY_CALLS": "Consider creating a shared library or API gateway",
}


def cluster_rows(report: DataFrame) -> DataFrame:
    """Clusters as the plan document holds them; report as of clusters.cluster_report with name."""
    metrics = F.struct("class_count", F.bround("internal_cohesion", 3).alias("internal_cohesion"), F.bround("external_coupling", 3).alias("external_coupling"), "complexity_score")
    return report.select(
        F.col("cluster_id").alias("id"), F.col("name").alias("suggested_name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("rationale"),
        "classes", metrics.alias("metrics"), "dominant_type", "entities", "entry_points",
    )


def warning_rows(report: DataFrame, boundary: DataFrame) -> DataFrame:
    w = clusters.warnings(report, boundary)
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv]), F.col("kind"))
    return w.select(F.col("kind").alias("type"), clusters.warning_text(F.col("kind"), F.col("service"), F.col("number")).alias("message"), hint.alias("suggestion"))


def _object(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def plan_document(name: str, project: str, report: DataFrame, boundary: DataFrame, assignment: DataFrame, metadata: dict | None = None, excluded: list[str] | None = None) -> DataFrame:
    """The lines of the plan document, one JSON object."""
    file, one = F.lit(name), report.sparkSession.range(1)
    counts = assignment.agg(F.count("*").alias("classes")).crossJoin(F.broadcast(report.agg(F.count("*").alias("services"))))  # one row each
    given = {"project_metadata": metadata or {}, "excluded_classes": excluded or []}
    head = F.concat(
        F.lit('{"project": ' + json.dumps(project) + ', "analysis_date": "' + time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()) + '", "total_classes": '), F.col("classes").cast("string"), F.lit(', "suggested_services": '), F.col("services").cast("string"),
        F.lit(", " + json.dumps(given)[1:-1] + ', "clusters": ['),
    )
    rows, calls, warned = cluster_rows(report), boundary.drop("seq").withColumn("refactoring_required", F.lit(True)), warning_rows(report, boundary)
    return union(
        lines(counts, file, 0, head),
        listed(lines(rows, file, 1, _object(rows), a=F.col("id"))),
        lines(one, file, 2, F.lit('], "boundary_calls": [')),
        listed(lines(calls, file, 3, _object(calls), c=F.concat_ws("\x01", "from_service", "to_service"), d=F.concat_ws("\x01", "from_class", "to_class"))),
        lines(one, file, 4, F.lit('], "warnings": [')),
        listed(lines(warned, file, 5, _object(warned), c=F.col("type"), d=F.col("message"))),
        lines(one, file, 6, F.lit("]}")),
    )


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, boundary calls) of a plan document, read by as many tasks as it has byte ranges."""
    found = materialize(jsondoc.elements(spark, path), "elements")
    part = lambda key, schema: found.where(F.col("key") == key).orderBy("pos").select(F.from_json("json", schema).alias("e")).select("e.*")
    return part("clusters", CLUSTER), part("boundary_calls", CALL)


def markdown_document(name: str, project: str, nodes: DataFrame, edges: DataFrame, assignment: DataFrame, report: DataFrame, boundary: DataFrame) -> DataFrame:
    """The lines of the Markdown report (headings and the summary's lines are fixed values): summary, a table for each cluster, pairs of services, recommendations, warnings."""
    file, one = F.lit(name), report.sparkSession.range(1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    percent = lambda c: F.floor(F.col(c) * 100)
    number = lambda df, n: df.agg(F.count("*").alias(n))
    counts = number(assignment, "classes").crossJoin(F.broadcast(number(report, "services"))).crossJoin(F.broadcast(number(boundary, "calls")))  # one row each
    head = [
        F.lit(f"# Migration Plan: {project}"), F.lit(""), F.lit("## Executive Summary"), F.lit(""), text("- **Total Classes Analyzed:** ", F.col("classes")), text("- **Suggested Microservices:** ", F.col("services")),
        text("- **Estimated Boundary Calls to Refactor:** ", F.col("calls")), F.lit(""), F.lit("## Suggested Service Decomposition"), F.lit(""),
    ]
    member = assignment.join(nodes, "id", "left").select("cluster_id", "node_seq", "id", simple_name(F.col("simple_name"), F.col("id")).alias("short"), F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("complexity_score", F.lit(0)).alias("score"))
    member = member.join(report.select("cluster_id"), "cluster_id", "left_semi")
    # A cluster's lines: head, a line for each class, then its entities and entry points. c orders these parts, d the classes.
    titles = [
        text("### ", F.col("cluster_id") + 1, ". ", F.col("name")), F.lit(""), text("**Classes:** ", F.col("class_count"), " | **Cohesion:** ", percent("internal_cohesion"), "% | **Coupling:** ", percent("external_coupling"), "%"), F.lit(""), F.lit("| Class | Type | Complexity |"), F.lit("| --- | --- | --- |"),
    ]
    place = F.coalesce("node_seq", F.lit((1 << 62)))
    each = lambda df, part, line: lines(df, file, 1, line, a=F.col("cluster_id"), c=F.lit(part), d=text(F.lpad(place.cast("string"), 20, "0"), F.col("id")))
    title = lambda kind, part, line: lines(member.where(F.col("type") == kind).select("cluster_id").distinct(), file, 1, [F.lit(""), F.lit(line)], a=F.col("cluster_id"), c=F.lit(part))
    shown = [
        lines(report, file, 1, titles, a=F.col("cluster_id"), c=F.lit("0")), each(member, "1", text("| ", F.col("short"), " | ", F.col("type"), " | ", F.col("score"), " |")),
        title("Entity", "2", "**Entities owned:**"), each(member.where("type = 'Entity'"), "3", text("- `", F.col("short"), "`")), title("Controller", "4", "**Entry points:**"), each(member.where("type = 'Controller'"), "5", text("- `", F.col("short"), "`")),
        lines(report, file, 1, [F.lit(""), F.lit("---"), F.lit("")], a=F.col("cluster_id"), c=F.lit("6")),
    ]
    pairs = clusters.first_calls(boundary)
    pair = text("| ", F.col("from_service"), " | ", F.col("to_service"), " | ", F.col("method"), " | ", F.col("priority"), " |")
    crossing = lines(boundary.limit(1), file, 2, [F.lit(x) for x in ("## Cross-Service Dependencies", "", "| From | To | Method | Priority |", "| --- | --- | --- | --- |")])
    advice = clusters.recommendations(report, edges, assignment)
    advice = lines(advice, file, 5, text("1. **", F.col("title"), "**", F.coalesce(F.format_string(" - coupling %.1f", F.col("number")), F.lit(""))), a=F.col("step"))
    warned = materialize(warning_rows(report, boundary), "warnings")
    told = lines(warned, file, 7, [text("- **", F.col("type"), ":** ", F.col("message")), text("  - Suggestion: ", F.col("suggestion"))], c=F.col("type"), d=F.col("message"))
    return union(
        lines(counts, file, 0, head), *shown, crossing, lines(pairs, file, 3, pair, c=F.col("from_service"), d=F.col("to_service")), lines(one, file, 4, [F.lit(""), F.lit("## Recommendations"), F.lit("")]), advice,
        lines(warned.limit(1), file, 6, [F.lit(""), F.lit("## Warnings"), F.lit("")]), told,
    )


#: Sections of a service in the guide: what a row's key and text fill.
SECTIONS = ["Classes", "Entities and their tables", "Entry points", "Endpoints", "Schemas"]
#: Properties of a schema that the guide lists.
LISTED = 10
STEPS = [
    ("Set up", "Create an empty project for the service with the libraries that its `spec.json` names."),
    ("Move classes", "Move entities first, then repositories, services and controllers, and compile after each kind."),
    ("Cut calls", "Give every row of the tables above a client of the other service's API in place of the direct call."),
    ("Split tables", "Write a migration that creates the service's own tables and copies their rows."),
    ("Join up", "Register the service's routes at the gateway, set time limits for its clients, and test both sides."),
]


def guide_rows(nodes: DataFrame, assignment: DataFrame, endpoints: DataFrame, fields: DataFrame) -> DataFrame:
    """(cluster_id, section, seq, key, text): what the guide says of each service, a row for each line. endpoints (id, path, http_method, name), fields (id, pos, name, api_type)."""
    member = assignment.join(nodes.select("id", "node_seq", "type", "simple_name"), "id")
    short = simple_name(F.col("simple_name"), F.col("id"))
    row = lambda df, section, key, text, seq="node_seq": df.select("cluster_id", F.lit(section).alias("section"), F.col(seq).cast("long").alias("seq"), key.alias("key"), text.alias("text"))
    table = F.concat(F.lit("`"), short, F.lit("`: table `"), F.lower(short), F.lit("s`"))
    called = endpoints.join(member.select("id", "cluster_id", "node_seq"), "id")
    listed = fields.join(member.where("type = 'Entity'"), "id").withColumn("short", short).groupBy("cluster_id", "id", "short", "node_seq").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat("name", F.lit(": "), "api_type").alias("t")))).alias("f")
    )  # an entity's fields
    more = F.when(F.size("f") > LISTED, F.concat(F.lit(", and "), (F.size("f") - LISTED).cast("string"), F.lit(" more"))).otherwise("")
    return (
        row(member, 0, F.col("id"), F.concat(F.lit("`"), "id", F.lit("`")))
        .unionByName(row(member.where("type = 'Entity'"), 1, F.col("id"), table))
        .unionByName(row(member.where("type = 'Controller'"), 2, F.col("id"), F.concat(F.lit("`"), short, F.lit("`"))))
        .unionByName(row(called, 3, F.concat_ws(" ", "path", "http_method"), F.concat(F.lit("`"), F.upper("http_method"), F.lit(" "), "path", F.lit("`: "), "name")))
        .unionByName(row(listed, 4, F.col("id"), F.concat(F.lit("`"), "short", F.lit("`: "), F.array_join(F.transform(F.slice("f", 1, LISTED), lambda x: x["t"]), ", "), more)))
    )


def guide_document(name: str, project: str, report: DataFrame, boundary: DataFrame, rows: DataFrame) -> DataFrame:
    """The lines of the implementation guide: services in order of coupling, each one's classes, tables, endpoints and schemas, the calls to cut, and the steps. rows as of guide_rows."""
    from ..operators.merge import sequential_ids

    file, one = F.lit(name), report.sparkSession.range(1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    services = materialize(report.select("cluster_id", "name", "class_count", "internal_cohesion", "external_coupling"), "services")
    counts = services.agg(F.count("*").alias("services")).crossJoin(F.broadcast(boundary.agg(F.count("*").alias("calls"))))  # one row each
    head = [F.lit(f"# Implementation Guide: {project}"), F.lit(""), text("- Services: ", F.col("services")), text("- Calls between services: ", F.col("calls")), *[F.lit(x) for x in ("", "## Order", "", "| # | Service | Classes | Coupling |", "| --- | --- | --- | --- |")]]
    order = sequential_ids(services, ["external_coupling", "cluster_id"], "i", 1)
    ordered = lines(order, file, 1, F.format_string("| %d | %s | %d | %.2f |", F.col("i").cast("long"), F.col("name"), F.col("class_count").cast("long"), F.col("external_coupling").cast("double")), a=F.col("i"))
    told = rows.join(services.select("cluster_id", "name"), "cluster_id")
    summed = F.format_string("%d classes, cohesion %.1f%%, coupling %.1f%%", F.col("class_count").cast("long"), (F.col("internal_cohesion") * 100).cast("double"), (F.col("external_coupling") * 100).cast("double"))
    titles = lines(services.join(rows.select("cluster_id").distinct(), "cluster_id", "left_semi"), file, 3, [F.lit(""), text("### ", F.col("name")), F.lit(""), summed], a=F.col("cluster_id"), b=-1)
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section") + 1)
    heads = lines(rows.select("cluster_id", "section").distinct(), file, 3, [F.lit(""), text("#### ", section), F.lit("")], a=F.col("cluster_id"), b=F.col("section") * 2)
    place = F.lpad(F.coalesce("seq", F.lit(1 << 62)).cast("string"), 20, "0")
    each = lines(told, file, 3, text("- ", F.col("text")), a=F.col("cluster_id"), b=F.col("section") * 2 + 1, c=place, d=F.col("key"))
    seq = F.lpad(F.coalesce("seq", F.lit(1 << 62)).cast("string"), 20, "0") if "seq" in boundary.columns else F.lit("")
    pair = F.concat_ws("\x01", "from_service", "to_service")
    cuts = lines(boundary.select("from_service", "to_service").distinct(), file, 5, [F.lit(""), text("### ", F.col("from_service"), " to ", F.col("to_service")), F.lit(""), F.lit("| From | To | Kind | Method |"), F.lit("| --- | --- | --- | --- |")], c=F.concat(pair, F.lit("\x010")))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    calls = lines(boundary, file, 5, text("| `", last("from_class"), "` | `", last("to_class"), "` | ", F.col("edge_type"), " | ", F.coalesce("method", F.lit("")), " |"), c=F.concat(pair, F.lit("\x011")), d=F.concat_ws("\x01", seq, "from_class", "to_class"))
    steps = [F.lit(f"{i}. **{name}.** {text_}") for i, (name, text_) in enumerate(STEPS, 1)]
    return union(
        lines(counts, file, 0, head), ordered, lines(one, file, 2, [F.lit(""), F.lit("## Services")]), titles, heads, each, lines(one, file, 4, [F.lit(""), F.lit("## Calls between services")]), cuts, calls,
        lines(one, file, 6, [F.lit(""), F.lit("## Steps for each service"), F.lit(""), *steps]),
    )


def diagrams(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster_id, name, diagram): a sequence diagram of each cluster.

    Takes part: the client, the controllers and the services and repositories that they call; without controllers the entities, and without
    those the cluster's first three classes.
    """
    n = nodes.select("id", "node_seq", simple_name(F.col("simple_name"), F.col("id")).alias("short"), F.coalesce("type", F.lit("Unknown")).alias("type"))
    member = assignment.join(n, "id")
    part = lambda df, kind, rank: df.select("cluster_id", F.lit(kind).alias("kind"), F.col("short"), F.lit(rank).alias("rank"))
    control = member.where("type = 'Controller'")
    called = control.select("cluster_id", F.col("id").alias("src")).join(edges.select("src", "dst"), "src").join(n.where("type IN ('Service', 'Repository')").select(F.col("id").alias("dst"), "short"), "dst")
    client = control.select("cluster_id").distinct().withColumn("short", F.lit("Client"))
    first3 = member.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("node_seq", "short", "type"))), 1, 3).alias("f")).select("cluster_id", F.inline("f"))
    rows = part(client, "actor", 1).unionByName(part(control, "participant", 1)).unionByName(part(called, "participant", 1)).unionByName(part(member.where("type = 'Entity'"), "entity", 2))
    rows = rows.unionByName(first3.select("cluster_id", F.when(F.col("type") == "Controller", "participant").otherwise("entity").alias("kind"), "short", F.lit(3).alias("rank")))
    best = rows.groupBy("cluster_id").agg(F.min("rank").alias("rank"))
    taken = rows.join(best, ["cluster_id", "rank"]).groupBy("cluster_id", "rank").agg(F.array_sort(F.collect_set(F.struct("short", "kind"))).alias("ps"))
    entry = control.groupBy("cluster_id").agg(F.min_by(F.element_at(F.split("id", r"\."), -1), "node_seq").alias("entry"))
    listed = F.array_join(F.transform("ps", lambda p: F.concat(p["kind"], F.lit(' "'), p["short"], F.lit('"'))), "\n")
    last = F.when(F.col("entry").isNotNull(), F.concat(F.lit("Client -> "), F.col("entry"), F.lit(": API Request"))).otherwise(F.concat(F.lit("note over "), F.col("ps")[0]["short"], F.lit(": Entity-only cluster")))
    text = F.concat(F.lit("@startuml\ntitle "), F.col("name"), F.lit(" API Flow\n\n"), listed, F.lit("\n\n"), last, F.lit("\n@enduml"))
    return taken.join(entry, "cluster_id", "left").join(names.select("cluster_id", "name"), "cluster_id").select("cluster_id", "name", text.alias("diagram"))


def compose_services(services: DataFrame, first_port: int = 18080) -> DataFrame:
    """(name, container_port, host_port, body) of services (name, port): the gateway first, then by name; a compose entry for each."""
    from ..operators.merge import sequential_ids

    order = sequential_ids(services.withColumn("late", (F.col("name") != "api-gateway").cast("int")), ["late", "name"], "i")
    others = services.where("name <> 'api-gateway'").agg(F.array_sort(F.collect_list("name")).alias("others"))  # services: as many as clusters
    port, host = F.col("port").cast("string"), (F.col("i") + first_port).cast("string")
    body = F.concat(
        F.lit("  "), F.col("name"), F.lit(":\n    image: "), F.col("name"), F.lit(':latest\n    ports:\n      - "'), host, F.lit(":"), port, F.lit('"\n    environment:\n      - SERVER_PORT='), port,
        F.lit('\n    healthcheck:\n      test: ["CMD-SHELL", "wget --spider -q http://localhost:'), port, F.lit('/actuator/health || exit 1"]'),
        F.when((F.col("name") == "api-gateway") & (F.size("others") > 0), F.concat(F.lit("\n    depends_on:"), F.array_join(F.transform("others", lambda o: F.concat(F.lit("\n      "), o, F.lit(":\n        condition: service_started"))), ""))).otherwise(""),
    )
    return order.crossJoin(F.broadcast(others)).select("i", "name", F.col("port").alias("container_port"), (F.col("i") + first_port).alias("host_port"), body.alias("body")).orderBy("i").drop("i")


def summary(results: DataFrame) -> DataFrame:
    """One row of service_results (success, cost): how many succeeded, of how many, at what cost."""
    return results.agg(F.count_if("success").alias("succeeded"), F.count("*").alias("total"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def routes(services: DataFrame) -> DataFrame:
    """(name, route): the gateway's table."""
    return services.select("name", F.concat(F.lit("/api/"), F.col("name"), F.lit("/**")).alias("route"))
