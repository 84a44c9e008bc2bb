"""Class hierarchies: resolving superclasses, inherited fields, component specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import boxed, field_annotations, last_part
from ..sources.scratch import materialize

def resolve_superclasses(classes: DataFrame) -> DataFrame:
    """(id, parent): a dotted superclass as it is; else the class of that name in the same package; else the first class by node_seq with that last part."""
    want = classes.where("superclass IS NOT NULL").select("id", "package", "superclass")
    by_package = classes.select("package", F.col("simple_name").alias("superclass"), F.col("id").alias("near"), "node_seq").groupBy("package", "superclass").agg(F.min_by("near", "node_seq").alias("near"))
    by_name = classes.select(last_part(F.col("id")).alias("superclass"), F.col("id").alias("far"), "node_seq").groupBy("superclass").agg(F.min_by("far", "node_seq").alias("far"))
    found = want.join(by_package, ["package", "superclass"], "left").join(by_name, "superclass", "left")
    return found.select("id", F.when(F.instr("superclass", ".") > 0, F.col("superclass")).otherwise(F.coalesce("near", "far")).alias("parent")).where("parent IS NOT NULL")


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, depth), nearest first from depth 1. A class that comes up again ends its walk.

    One join a level, all classes at once, to the deepest; the levels' paths carry the cycle guard.
    """
    step = materialize(parents.select("id", F.col("parent").alias("ancestor"), F.array("id", "parent").alias("path")).where("id <> parent"), "level")
    out, depth = step.select("id", "ancestor", F.lit(1).alias("depth")), 1
    up = parents.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        step = step.join(up, "ancestor").where(~F.array_contains("path", F.col("next"))).select("id", F.col("next").alias("ancestor"), F.concat("path", F.array("next")).alias("path"))
        step = materialize(step, "level")
        if step.isEmpty():
            return out
        depth += 1
        out = out.unionByName(step.select("id", "ancestor", F.lit(depth).alias("depth")))


def all_fields(classes: DataFrame) -> DataFrame:
    """(id, pos, name, type, inherited, depth): own fields, then inherited ones nearest first; of one name the first counts."""
    fields = classes.select("id", F.posexplode("fields").alias("at", "f")).select("id", "at", "f.name", "f.type")
    chain = ancestors(resolve_superclasses(classes))
    inherited = chain.join(fields.withColumnRenamed("id", "ancestor"), "ancestor").select("id", "depth", "at", "name", "type")
    both = fields.select("id", F.lit(0).alias("depth"), "at", "name", "type").unionByName(inherited)
    first = F.row_number().over(Window.partitionBy("id", "name").orderBy("depth", "at"))
    kept = both.withColumn("n", first).where("n = 1")
    pos = F.row_number().over(Window.partitionBy("id").orderBy("depth", "at")) - 1
    return kept.select("id", pos.alias("pos"), "name", "type", (F.col("depth") > 0).alias("inherited"), "depth")


def external_superclasses(classes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(id, parent): superclasses in another cluster or in none."""
    c = lambda side: assignment.select(F.col("id").alias(side), F.col("cluster_id").alias(f"{side}_c"))
    p = resolve_superclasses(classes).join(c("id"), "id", "left").join(c("parent"), "parent", "left")
    return p.where(~F.coalesce(F.col("id_c") == F.col("parent_c"), F.lit(False))).select("id", "parent")


def uses_shared(classes: DataFrame, assignment: DataFrame, names: DataFrame, shared: tuple[str, ...] = ("shared-service", "common-service", "shared")) -> DataFrame:
    """(cluster_id): clusters with a class whose superclass is in a shared cluster."""
    hubs = names.where(F.col("name").isin(*shared)).select(F.col("cluster_id").alias("hub"))
    p = resolve_superclasses(classes).join(assignment, "id").join(assignment.select(F.col("id").alias("parent"), F.col("cluster_id").alias("hub")), "parent")
    return p.join(hubs, "hub", "left_semi").where("cluster_id <> hub").select("cluster_id").distinct()


def entity_specs(classes: DataFrame) -> DataFrame:
    """(id, name, fields array<struct<name,type,annotations,inherited>>, id_type): entities with all their fields; the id's type boxed, Long without an id."""
    entities = classes.where("type = 'Entity'")
    f = all_fields(classes).join(entities.select("id"), "id", "left_semi")
    packed = f.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type", field_annotations(F.col("name")).alias("annotations"), "inherited"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["annotations"].alias("annotations"), x["inherited"].alias("inherited"))).alias("fields"),
        F.max(F.when(F.col("name") == "id", boxed(F.col("type")))).alias("id_type"),
    )
    return entities.select("id", F.col("simple_name").alias("name")).join(packed, "id", "left").select("id", "name", "fields", F.coalesce("id_type", F.lit("Long")).alias("id_type"))


def component_specs(classes: DataFrame, assignment: DataFrame, kind: str) -> DataFrame:
    """(cluster_id, components array<struct<id,name,methods>>) of one type (Repository, Service, Controller)."""
    rows = classes.where(F.col("type") == kind).join(assignment, "id")
    one = F.struct("node_seq", "id", F.col("simple_name").alias("name"), F.transform("methods", lambda m: m["name"]).alias("methods"))
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(one)).alias("components"))


def schemas(classes: DataFrame) -> DataFrame:
    """(id, pos, name, api_type): an entity's fields without its relations."""
    from ..functions.classify import api_type

    fields = classes.where("type = 'Entity'").select("id", F.posexplode("fields").alias("pos", "f")).select("id", "pos", "f.name", "f.type")
    related = classes.select("id", F.explode("jpa_relationships").alias("r")).select("id", F.col("r.field_name").alias("name"))
    return fields.join(related, ["id", "name"], "left_anti").select("id", "pos", "name", api_type(F.col("type")).alias("api_type"))


def iteration_budget(entities, repositories, services, controllers):
    """max(15, twice the number of files expected)."""
    return F.greatest(F.lit(15), 2 * (4 + entities + repositories + services + controllers))
