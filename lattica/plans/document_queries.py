"""Named queries that write documents of the relational graph and read them again by byte ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..operators import clusters
from ..sources import documents
from ..sources.relational import Tables, assignment, nodes, raw_edges
from ..sources.scratch import materialize, scratch_dir
from . import report

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def _graph(t: Tables) -> CodeGraph:
    """Customers, nations and orders, with what orders and customers refer to."""
    from ..operators.merge import merge_edges

    n = nodes(t, "nation", "customer", "orders").withColumns({"complexity_score": F.col("complexity_score").cast("int"), "annotations": F.array(F.lit('say "x"'), F.lit("}{")), "is_abstract": F.lit(False)})
    return CodeGraph(n, merge_edges(raw_edges(t, "customer", "orders")).select("src", "dst", "type", "weight", "types"))


def _written(t: Tables, rows: DataFrame) -> str:
    """The folder that holds the documents of rows; it goes with the session's other scratch."""
    folder = f"{scratch_dir(t.spark)}/lattica-documents-{uuid.uuid4().hex}"
    documents.write(rows, folder, part_lines=20_000)
    fs, make = documents.file_system(t.spark, folder)
    fs.deleteOnExit(make(folder))
    return folder


@query
def graph_document(t):
    """Nodes and edges of a graph's JSON document, written by executors and read by byte ranges of 256 kB."""
    g = _graph(t)
    folder = _written(t, g.document("graph.json"))
    from ..sources import jsondoc

    found = materialize(jsondoc.elements(t.spark, f"{folder}/graph.json", range_bytes=256 << 10), "elements")
    n = found.where("key = 'nodes'").select("pos", F.from_json("json", "id string, type string, node_seq long, annotations array<string>").alias("e"))
    e = found.where("key = 'edges'").select("pos", F.from_json("json", "source string, target string, type string, weight double, types array<string>").alias("e"))
    return n.select("pos", F.col("e.id").alias("id"), F.lit("").alias("target"), "e.type", F.col("e.node_seq").cast("double").alias("number"), F.array_join("e.annotations", ",").alias("list")).unionByName(
        e.select("pos", F.col("e.source").alias("id"), F.col("e.target").alias("target"), "e.type", F.col("e.weight").alias("number"), F.array_join("e.types", ",").alias("list"))
    )


@query
def graphml_document(t):
    """K2: the lines of a GraphML document, as Spark reads the file."""
    folder = _written(t, _graph(t).document("graph.graphml", "graphml"))
    return t.spark.read.text(f"{folder}/graph.graphml").select(F.col("value").alias("line"))


@query
def plan_document(t):
    """Clusters and boundary calls of a plan document, written by executors and read again."""
    n, e, a = nodes(t, "region", "nation", "customer"), CodeGraph.from_raw(nodes(t, "region", "nation", "customer"), raw_edges(t, "nation", "customer")).edges, assignment(t).where("id LIKE 'region%' OR id LIKE 'nation%' OR id LIKE 'customer%'")
    # Customers lie in the next region's cluster, so that calls cross.
    a = a.withColumn("cluster_id", F.when(F.col("id").startswith("customer"), (F.col("cluster_id") + 1) % 5).otherwise(F.col("cluster_id")))
    r = materialize(clusters.dedup_names(clusters.cluster_report(n, e, a), "base_name", "cluster_id"), "report")
    calls = materialize(clusters.boundary_edges(e, a, r.select("cluster_id", "name")), "calls")
    folder = _written(t, report.plan_document("plan.json", "tpc", r, calls, a))
    c, b = report.read_plan(t.spark, f"{folder}/plan.json")
    c = c.select(F.col("id").cast("string").alias("key"), F.size("classes").cast("long").alias("n"), F.col("metrics.external_coupling").alias("number"), F.lit("cluster").alias("kind"))
    return c.unionByName(b.select(F.concat_ws(">", "from_class", "to_class").alias("key"), F.lit(1).cast("long").alias("n"), F.col("weight").alias("number"), F.when(F.col("refactoring_required"), F.col("edge_type")).alias("kind")))


_N = """n AS (SELECT 10000000000000 + n_nationkey AS s, 'nation:' || n_nationkey AS id, 'Service' AS type, n_nationkey AS score, 'nation' AS package, n_name AS name FROM nation
  UNION ALL SELECT 20000000000000 + c_custkey, 'customer:' || c_custkey, 'Entity', 0, 'customer', c_name FROM customer UNION ALL SELECT 50000000000000 + o_orderkey, 'orders:' || o_orderkey, 'Repository', 0, 'orders', o_orderpriority FROM orders),
e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'INHERITS' AS type, 10.0::DOUBLE AS w FROM customer UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'CALLS', 5.0::DOUBLE FROM orders)"""

ORACLE = {
    "graph_document": f"""WITH {_N} SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS pos, id, '' AS target, type, s::DOUBLE AS number, 'say "x",}}{{' AS list FROM n
UNION ALL SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY src, dst) - 1, src, dst, type, w, type FROM e""",
    "graphml_document": f"""WITH {_N} SELECT unnest(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="node_node_seq" for="node" attr.name="node_seq" attr.type="long"/>',
  '<key id="node_type" for="node" attr.name="type" attr.type="string"/>', '<key id="node_complexity_score" for="node" attr.name="complexity_score" attr.type="int"/>', '<key id="node_package" for="node" attr.name="package" attr.type="string"/>',
  '<key id="node_simple_name" for="node" attr.name="simple_name" attr.type="string"/>', '<key id="node_annotations" for="node" attr.name="annotations" attr.type="string"/>', '<key id="node_is_abstract" for="node" attr.name="is_abstract" attr.type="boolean"/>',
  '<key id="edge_type" for="edge" attr.name="type" attr.type="string"/>', '<key id="edge_weight" for="edge" attr.name="weight" attr.type="double"/>', '<key id="edge_types" for="edge" attr.name="types" attr.type="string"/>',
  '<graph edgedefault="directed">', '</graph>', '</graphml>']) AS line
UNION ALL SELECT '<node id="' || id || '"><data key="node_node_seq">' || s || '</data><data key="node_type">' || type || '</data><data key="node_complexity_score">' || score || '</data><data key="node_package">' || package || '</data><data key="node_simple_name">' || name ||
  '</data><data key="node_annotations">["say \\"x\\"","}}{{"]</data><data key="node_is_abstract">false</data></node>' FROM n
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="edge_type">' || type || '</data><data key="edge_weight">' || w || '</data><data key="edge_types">["' || type || '"]</data></edge>' FROM e""",
    "plan_document": """WITH m AS (SELECT 'region:' || r_regionkey AS id, r_regionkey AS c FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'customer:' || c_custkey, (n_regionkey + 1) % 5 FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
x AS (SELECT a, b, ma.c AS ca, mb.c AS cb FROM e JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b WHERE ma.c <> mb.c),
k AS (SELECT c, count(*) AS n FROM (SELECT ca AS c FROM x UNION ALL SELECT cb FROM x) GROUP BY c)
SELECT m.c::VARCHAR AS key, count(*) AS n, round_even(any_value(coalesce(k.n, 0))::DOUBLE / count(*), 3) AS number, 'cluster' AS kind FROM m LEFT JOIN k ON k.c = m.c GROUP BY m.c
UNION ALL SELECT a || '>' || b, 1, 10.0::DOUBLE, 'INHERITS' FROM x""",
}
