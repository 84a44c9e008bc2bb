"""Whole runs: scan, cluster, report, with incremental reuse and checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.classify import class_text
from ..functions.extract import endpoints
from ..graph import CodeGraph
from ..operators import algorithms, clusters, hierarchy, vectors, weights
from ..operators.merge import sequential_ids
from ..sources import documents, incremental, java
from ..sources.scratch import materialize
from . import openapi, specs
from . import report as reports


@dataclass
class Plan:
    assignment: DataFrame
    report: DataFrame
    boundary: DataFrame


class Analyzer:
    """Analyses a source tree: analyze(), then plan() by hybrid weights or plan_by_packages(), then write()."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, cache: str | None = None, include_placeholders: bool = True):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.snapshots = incremental.Snapshots(spark, cache) if cache else None
        self.include_placeholders = include_placeholders
        self.classes: DataFrame | None = None
        self.graph: CodeGraph | None = None
        self.current: Plan | None = None
        #: Files that the last analyze() parsed anew.
        self.parsed_files = 0

    def analyze(self) -> CodeGraph:
        """Parses what is new or changed since the snapshot, drops what is gone, and builds the graph."""
        sources = java.scan(self.spark, self.root, self.config.ignore_paths)
        hashes = materialize(sources.select("file_path", "content_hash"), "hashes")
        stored = self.snapshots.load() if self.snapshots else None
        if stored is None or not {"parsed_files", "classes"} <= stored.keys():  # or only a stream's table
            parsed = materialize(java.classes(sources), "classes")
            self.parsed_files = hashes.count()
        else:
            state = materialize(incremental.changes(stored["parsed_files"], hashes), "changes")
            fresh = sources.join(state.where("state IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
            kept = stored["classes"].join(state.where("state = 'unchanged'").select("file_path"), "file_path", "left_semi")
            parsed = materialize(kept.unionByName(java.classes(fresh)), "classes")
            self.parsed_files = state.where("state IN ('new', 'changed')").count()
        self.classes = parsed
        self.graph = CodeGraph(*[materialize(t, "graph") for t in java.graph_tables(parsed)])
        if self.snapshots:
            self.snapshots.save({"parsed_files": hashes, "classes": parsed, "nodes": self.graph.nodes, "edges": self.graph.edges}, file_count=hashes.count())
        return self.graph

    def _members(self) -> DataFrame:
        graph = self.graph or self.analyze()
        return graph.nodes if self.include_placeholders else graph.nodes.where("file_path IS NOT NULL")

    def plan(self, encoder=None) -> Plan:
        """Communities of the hybrid weights."""
        nodes = self._members()
        # Placeholders come after all parsed nodes, by name.
        unseen = sequential_ids(nodes.where("node_seq IS NULL").select("id", "type"), ["id"], "node_seq", 1 << 50)
        order = materialize(nodes.where("node_seq IS NOT NULL").select("id", "node_seq", "type").unionByName(unseen.select("id", F.col("node_seq").cast("long").alias("node_seq"), "type")), "order")
        c = self.classes.where("parsed")
        text = class_text(F.col("fully_qualified_name"), F.col("is_interface"), F.col("is_abstract"), F.col("annotations"), F.col("methods"), F.col("fields"))
        vecs = vectors.embed(c.select(F.col("fully_qualified_name").alias("id"), text.alias("text")).dropDuplicates(["id"]), encoder)
        links = materialize(weights.hybrid_weights(order, self.graph.edges, vecs, *self.config.weights), "weights")
        found = algorithms.detect_communities(order, links, self.config.algorithm, self.config.resolution, self.config.constraints)
        return self._finish(materialize(found, "assignment"), stacks=False)

    def plan_by_packages(self) -> Plan:
        """One service for each package of domain classes: the proposal made without a language model."""
        known = self.graph or self.analyze()
        domain = known.nodes.where(F.col("type").isin("Entity", "Controller", "Service", "Repository"))
        return self._finish(materialize(clusters.package_proposal(domain), "assignment"), stacks=True)

    def _finish(self, assignment: DataFrame, stacks: bool) -> Plan:
        report = clusters.cluster_report(self.graph.nodes, self.graph.edges, assignment)
        if stacks:
            better = clusters.stack_report(self.graph.nodes, self.graph.edges, assignment).select("cluster_id", F.col("internal_cohesion").alias("c"))
            report = report.join(better, "cluster_id").withColumn("internal_cohesion", F.col("c")).drop("c")
        report = materialize(clusters.dedup_names(report, "base_name", "cluster_id"), "report")
        self.current = Plan(assignment, report, materialize(clusters.boundary_edges(self.graph.edges, assignment, report.select("cluster_id", "name")), "boundary"))
        return self.current

    def endpoints(self) -> DataFrame:
        c = self.classes.where("parsed").where(F.size("mapped") > 0)
        return endpoints(c.select(F.col("fully_qualified_name").alias("id"), F.col("base_path").alias("base"), F.col("mapped").alias("methods")))

    def _typed(self) -> DataFrame:
        """The class records that the graph's nodes come from, with their types and order."""
        records = self.classes.where("parsed").select(F.col("fully_qualified_name").alias("id"), "file_path", F.col("package_name").alias("package"), "simple_name", "superclass", "fields", "jpa_relationships")
        return records.join(self.graph.nodes.select("id", "file_path", "node_seq", "type"), ["id", "file_path"])

    def specs(self) -> DataFrame:
        """The components of every service's specification, with the sources as they are now."""
        p = self.current or self.plan()
        sources = java.scan(self.spark, self.root, self.config.ignore_paths).select("file_path", "source")
        return specs.components(self._typed().join(sources, "file_path", "left"), p.boundary, p.assignment, p.report.select("cluster_id", "name"))

    def write(self, folder: str) -> None:
        """plan.json, plan.md, guide.md, and for each service openapi.yaml, spec.json and diagrams/api-flow.puml; files of services that the last plan here had and this one hasn't go."""
        p, name = self.current or self.plan(), self.config.name
        names = materialize(p.report.select("cluster_id", "name"), "names")
        _remove_renamed(f"{folder}/services", names)
        typed, points = materialize(self._typed(), "typed"), materialize(self.endpoints(), "endpoints")
        parts = openapi.document_parts(points, openapi.entity_schemas(typed), p.assignment, typed.select("id", F.col("node_seq").alias("seq")))
        drawn = reports.diagrams(self.graph.nodes, self.graph.edges, p.assignment, p.report)
        guide = materialize(reports.guide_rows(self.graph.nodes, p.assignment, points, hierarchy.schemas(typed)), "guide")
        # One after the other: a plan of all of them together takes longer to plan than to run.
        documents.write(reports.plan_document("plan.json", name, p.report, p.boundary, p.assignment), folder)
        documents.write(reports.markdown_document("plan.md", name, self.graph.nodes, self.graph.edges, p.assignment, p.report, p.boundary), folder)
        documents.write(reports.guide_document("guide.md", name, p.report, p.boundary, guide), folder)
        documents.write(documents.lines(drawn, F.concat(F.lit("services/"), F.col("name"), F.lit("/diagrams/api-flow.puml")), 0, F.col("diagram")), folder)
        documents.write(openapi.documents_of(names, materialize(parts, "parts")), folder)
        documents.write(specs.documents_of(names, materialize(self.specs(), "specs")), folder)


#: What write() puts into a service's folder.
SERVICE_FILES = ["openapi.yaml", "spec.json", "diagrams/api-flow.puml"]


def _remove_renamed(services: str, names: DataFrame) -> None:
    """Takes away what write() put into folders of services that are no more; other files and their folders stay."""
    spark = names.sparkSession
    fs, make = documents.file_system(spark, services)
    if not fs.exists(make(services)):
        return
    there = [(s.getPath().getName(),) for s in fs.listStatus(make(services)) if s.isDirectory()]
    gone = spark.createDataFrame(there, "name string").join(names, "name", "left_anti").collect() if there else []
    for old in (f"{services}/{r['name']}" for r in gone):
        for name in SERVICE_FILES:
            fs.delete(make(f"{old}/{name}"), False)
        for folder in (f"{old}/diagrams", old):
            if fs.exists(make(folder)) and not len(fs.listStatus(make(folder))):
                fs.delete(make(folder), False)


def run(spark: SparkSession, root: str, out: str, config: Config | None = None, checkpoints: str | None = None) -> dict:
    """All data steps; a step whose checkpoint exists is skipped. Returns the summary."""
    steps = incremental.Checkpoints(checkpoints or f"{out}/checkpoints")
    a = Analyzer(spark, root, config, cache=f"{out}/cache")
    graph = a.analyze()
    if not steps.exists("analysis"):
        steps.save("analysis", {"nodes": graph.nodes.count(), "edges": graph.edges.count()})
    if not (steps.exists("clustering") and steps.exists("documentation")):
        p = a.plan_by_packages()
        steps.save("clustering", {"services": p.report.count()})
        a.write(out)
        steps.save("documentation", {"folder": out})
    return {s: steps.load(s) for s in steps.completed()}
