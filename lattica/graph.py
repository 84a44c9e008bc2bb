"""CodeGraph: nodes and edges as two DataFrames, with readers, writers and the operators as methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algorithms, merge
from .sources import documents, jsondoc
from .sources.documents import escaped
from .sources.scratch import materialize

NODES = "node_seq long, id string, type string, complexity_score int, file_path string, package string, simple_name string, is_interface boolean, is_abstract boolean, annotations array<string>, method_count int, field_count int, superclass string, fields array<struct<type:string,name:string>>"
EDGES = "src string, dst string, type string, weight double, types array<string>, method_name string, seq long"


class CodeGraph:
    """A typed, weighted, directed graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def from_sources(cls, spark: SparkSession, root: str, ignore: list[str] | None = None) -> CodeGraph:
        from .sources.java import classes, graph_tables, scan

        return cls(*graph_tables(materialize(classes(scan(spark, root, ignore)), "classes")))

    @classmethod
    def from_raw(cls, nodes: DataFrame, raw_edges: DataFrame) -> CodeGraph:
        edges = merge.merge_edges(raw_edges)
        return cls(merge.with_placeholders(nodes, edges), edges)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> CodeGraph:
        """From a document {nodes: [{id, ..}], edges: [{source, target, ..}]}, read by as many tasks as it has byte ranges."""
        elements = materialize(jsondoc.elements(spark, path), "elements")
        n = elements.where("key = 'nodes'").select("pos", F.from_json("json", f"struct<{_struct(NODES)}>").alias("n"))
        nodes = n.select(F.coalesce("n.node_seq", "pos").alias("node_seq"), *[F.col(f"n.{f}") for f in _names(NODES) if f != "node_seq"])
        e = elements.where("key = 'edges'").select(F.from_json("json", "struct<source:string,target:string,type:string,weight:double,types:array<string>,method_name:string,seq:bigint>").alias("e"))
        return cls(nodes, e.select("e.*").withColumnsRenamed({"source": "src", "target": "dst"}))

    def write_json(self, path: str) -> None:
        """The document as lines: each node and edge a JSON object in folders nodes and edges."""
        self.nodes.write.mode("overwrite").json(f"{path}/nodes")
        self.edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/edges")

    def export(self, path: str, format: str = "json") -> None:
        """One file, written by executors: json or graphml."""
        if format not in ("json", "graphml"):
            raise ValueError(f"unknown format {format!r}")
        folder, _, name = path.rpartition("/")
        documents.write(self.document(name, format), folder or ".")

    def document(self, name: str, format: str = "json") -> DataFrame:
        """The lines of a document of the whole graph, in rows as :mod:`lattica.sources.documents` writes them. Lists and structs are JSON strings in GraphML; nulls are left out."""
        file = F.lit(name)
        one = self.nodes.sparkSession.range(1)
        if format == "json":
            nodes = documents.lines(self.nodes, file, 1, F.to_json(F.struct(*self.nodes.columns)), a=F.col("node_seq"), c=F.col("id"))
            edges = self.edges.withColumnsRenamed({"src": "source", "dst": "target"})
            edges = documents.lines(edges, file, 3, F.to_json(F.struct(*edges.columns)), c=F.col("source"), d=F.col("target"))
            fixed = [documents.lines(one, file, s, F.lit(t)) for s, t in ((0, '{"nodes": ['), (2, '],\n"edges": ['), (4, "]}"))]
            return documents.union(*fixed, documents.listed(nodes), documents.listed(edges))
        kinds = {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}
        head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
        for of, df in (("node", self.nodes), ("edge", self.edges)):
            head += [f'<key id="{of}_{n}" for="{of}" attr.name="{n}" attr.type="{kinds.get(kind, "string")}"/>' for n, kind in df.dtypes if n not in ("id", "src", "dst")]

        def data(of: str, df: DataFrame) -> Column:
            text = lambda n, kind: F.to_json(n) if kind.startswith(("array", "struct", "map")) else F.col(n).cast("string")
            return F.concat(F.lit(""), *[F.when(F.col(n).isNotNull(), F.concat(F.lit(f'<data key="{of}_{n}">'), escaped(text(n, kind)), F.lit("</data>"))).otherwise("") for n, kind in df.dtypes if n not in ("id", "src", "dst")])

        attribute = lambda c: escaped(F.col(c), quotes=True)
        node = F.concat(F.lit('<node id="'), attribute("id"), F.lit('">'), data("node", self.nodes), F.lit("</node>"))
        edge = F.concat(F.lit('<edge source="'), attribute("src"), F.lit('" target="'), attribute("dst"), F.lit('">'), data("edge", self.edges), F.lit("</edge>"))
        return documents.union(
            documents.lines(one, file, 0, [F.lit(x) for x in [*head, '<graph edgedefault="directed">']]), documents.lines(self.nodes, file, 1, node, c=F.col("id")),
            documents.lines(self.edges, file, 2, edge, c=F.col("src"), d=F.col("dst")), documents.lines(one, file, 3, [F.lit("</graph>"), F.lit("</graphml>")]),
        )

    def render_tables(self) -> tuple[DataFrame, DataFrame]:
        """What a drawing needs: (id, label, type, size) and (src, dst, width)."""
        short = F.coalesce("simple_name", F.element_at(F.split("id", r"\."), -1))
        label = F.when(F.length(short) > 20, F.concat(F.substring(short, 1, 17), F.lit("..."))).otherwise(short)
        nodes = self.nodes.select("id", label.alias("label"), F.coalesce("type", F.lit("Unknown")).alias("type"), (2 * F.coalesce("complexity_score", F.lit(0)) + 10).alias("size"))
        return nodes, self.edges.select("src", "dst", F.least(F.col("weight") / 2, F.lit(5.0)).alias("width"))

    def statistics(self) -> DataFrame:
        return algorithms.statistics(self.nodes, self.edges)

    def subgraph(self, ids: DataFrame) -> CodeGraph:
        return CodeGraph(*merge.induced_subgraph(self.nodes, self.edges, ids))

    def dependencies(self, node: str) -> DataFrame:
        return merge.dependencies_of(self.edges, node)

    def dependents(self, node: str) -> DataFrame:
        return merge.dependents_of(self.edges, node)


def _fields(schema: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += c
    return out


def _names(schema: str) -> list[str]:
    return [n for n, _ in _fields(schema)]


def _struct(schema: str) -> str:
    return ",".join(f"{n}:{'bigint' if k == 'long' else k}" for n, k in _fields(schema))
