"""Specifications of services: what a generator is told of each cluster, as one nested document for each.

Spark makes a row for each component (an entity, a repository, a client ..), whose document is JSON text, and executors write a
service's rows in order into its file. No service is gathered, whatever number of classes it has.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import base_package, last_part, table_name
from ..functions.extract import base_path, relationships
from ..operators import hierarchy
from ..sources import documents

#: Libraries of every service, and the versions without others.
LIBRARIES = ["spring-boot-starter-web", "spring-boot-starter-data-jpa", "spring-boot-starter-validation", "h2", "flyway-core"]
BOOT_VERSION, JAVA_VERSION = "3.2.0", 17
#: The lists of a document, in order; the head comes first.
PARTS = ["entities", "repositories", "services", "controllers", "gateway_clients"]
#: The service whose classes others extend.
SHARED = ("shared-service",)


def _doc(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("doc")


def components(classes: DataFrame, boundary: DataFrame, assignment: DataFrame, names: DataFrame, boot_version: str = BOOT_VERSION, java_version: int = JAVA_VERSION) -> DataFrame:
    """(cluster_id, part, seq, key, doc) of every service.

    classes (node_seq, id, package, simple_name, type, superclass, fields, source); boundary with from_class, to_service, method; names
    (cluster_id, name). The part "head" is the service itself. Ids without a class and sources that are null give what they can.
    """
    member = assignment.select("id", "cluster_id").join(classes.select("id", "node_seq", "package", "type", "superclass", F.coalesce("source", F.lit("")).alias("source")), "id")
    short = last_part(F.col("id"))
    row = lambda df, part, doc: df.select("cluster_id", F.lit(part).alias("part"), F.col("node_seq").alias("seq"), F.col("id").alias("key"), doc)
    nothing = F.array().cast("array<string>")

    first = member.groupBy("cluster_id").agg(F.min_by(F.struct("package"), F.struct("node_seq", "id")).alias("f"))
    sharing = hierarchy.uses_shared(classes, assignment, names, SHARED).withColumn("shared", F.lit(True))
    head = names.select("cluster_id", "name").join(first, "cluster_id", "left").join(sharing, "cluster_id", "left")
    head = head.select(
        "cluster_id", F.lit("head").alias("part"), F.lit(0).cast("long").alias("seq"), F.col("name").alias("key"),
        _doc("name", base_package(F.col("f.package"), F.col("name")).alias("base_package"), F.lit(boot_version).alias("spring_boot_version"), F.lit(java_version).alias("java_version"), F.array(*map(F.lit, LIBRARIES)).alias("maven_dependencies"), F.coalesce("shared", F.lit(False)).alias("depends_on_shared")),
    )

    entity = member.where("type = 'Entity'")
    related = relationships(entity.select("id", "source"))
    kind = F.struct(F.col("relation").alias("type"), F.col("target").alias("target_entity"), F.col("field").alias("field_name"), *[F.lit(None).cast("string").alias(x) for x in ("mapped_by", "cascade", "fetch")])
    related = related.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("relation", "pos", kind.alias("r")))), lambda x: x["r"]).alias("relationships"))
    outside = hierarchy.external_superclasses(classes, assignment).select("id", F.lit(True).alias("outside"))
    full = entity.join(hierarchy.entity_specs(classes).select("id", "fields", "id_type"), "id", "left").join(related, "id", "left").join(outside, "id", "left")
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), f["annotations"].alias("annotations"), f["inherited"].alias("is_inherited")))
    entities = row(full, "entities", _doc(
        F.col("id").alias("fqn"), short.alias("simple_name"), table_name(short, F.col("source")).alias("table_name"), F.coalesce(fields, F.array()).alias("fields"), F.coalesce("relationships", F.array()).alias("relationships"), nothing.alias("methods"),
        F.when(F.col("outside"), F.col("superclass")).alias("superclass"), F.col("source").alias("source_code"),
    ))
    repositories = row(full, "repositories", _doc(F.concat(short, F.lit("Repository")).alias("interface_name"), F.col("id").alias("entity_fqn"), short.alias("entity_simple_name"), F.coalesce("id_type", F.lit("Long")).alias("id_type"), nothing.alias("custom_methods")))
    services = row(member.where("type = 'Service'"), "services", _doc(F.col("id").alias("fqn"), short.alias("simple_name"), nothing.alias("dependencies"), nothing.alias("methods"), F.col("source").alias("source_code")))
    controllers = row(member.where("type = 'Controller'"), "controllers", _doc(F.col("id").alias("fqn"), short.alias("simple_name"), base_path(F.col("source")).alias("base_path"), nothing.alias("dependencies"), nothing.alias("endpoints"), F.col("source").alias("source_code")))

    calls = boundary.join(assignment.select(F.col("id").alias("from_class"), "cluster_id"), "from_class")
    asked = calls.groupBy("cluster_id", "to_service").agg(F.array_sort(F.collect_list("method")).alias("methods"))
    clients = asked.select("cluster_id", F.lit("gateway_clients").alias("part"), F.lit(0).cast("long").alias("seq"), F.col("to_service").alias("key"), _doc(F.col("to_service").alias("target_service"), F.col("methods").alias("methods_needed")))
    out = head
    for part in (entities, repositories, services, controllers, clients):
        out = out.unionByName(part)
    return out


def documents_of(names: DataFrame, parts: DataFrame, folder: str = "services") -> DataFrame:
    """The lines of every service's document, of names (cluster_id, name) and parts as of components: the head's fields, then a list for each of PARTS."""
    file = F.concat(F.lit(f"{folder}/"), F.col("name"), F.lit("/spec.json"))
    own = parts.join(names, "cluster_id")
    head = documents.lines(own.where("part = 'head'"), file, 0, F.concat(F.lit("{"), F.expr("substring(doc, 2, length(doc) - 2)")))
    out = [head]
    for i, part in enumerate(PARTS):
        out.append(documents.lines(names, file, 2 * i + 1, F.lit("]" * bool(i) + f',"{part}":[')))
        out.append(documents.listed(documents.lines(own.where(F.col("part") == part), file, 2 * i + 2, F.col("doc"), a=F.col("seq"), c=F.col("key"))))
    return documents.union(*out, documents.lines(names, file, 2 * len(PARTS) + 1, F.lit("]}")))


def lines(head: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """A service's document, line by line, from its head and its (part, doc) in order of PARTS, for a caller that holds them; whole runs use :func:`documents_of`."""
    yield "{" + head.strip()[1:-1]
    row = next(rows, None)
    for part in PARTS:
        yield f',"{part}":['
        comma = ""
        while row is not None and row[0] == part:
            yield comma + row[1]
            comma, row = ",", next(rows, None)
        yield "]"
    yield "}"
