import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.graph import CodeGraph
from lattica.operators import algorithms as al
from lattica.operators import clusters as cl
from lattica.operators import merge, weights


@pytest.fixture(scope="module")
def two_triangles(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    nodes = spark.createDataFrame([(i, n) for i, n in enumerate("abcdefg")], "node_seq long, id string")
    return nodes, spark.createDataFrame([(a, b, 1.0) for a, b in links], "a string, b string, weight double")


def raw(spark, rows):
    return spark.createDataFrame(rows, "seq long, src string, dst string, type string, weight double, method_name string")


def test_merge_keeps_the_first_and_adds_up(spark):
    e = merge.merge_edges(raw(spark, [(3, "a", "b", "INHERITS", 10.0, "late"), (1, "a", "b", "IMPORTS", 1.0, None), (4, "a", "b", "IMPORTS", 1.0, "x"), (2, "b", "a", "CALLS", 5.0, "m")]))
    got = {(r.src, r.dst): r for r in e.collect()}
    ab = got["a", "b"]
    assert (ab.type, ab.weight, ab.types, ab.method_name) == ("IMPORTS", 12.0, ["IMPORTS", "INHERITS"], None)
    assert got["b", "a"].method_name == "m"


def test_placeholders_and_neighbours(spark):
    nodes = spark.createDataFrame([(0, "a", "Entity")], "node_seq long, id string, type string")
    g = CodeGraph.from_raw(nodes, raw(spark, [(1, "a", "b", "CALLS", 5.0, None), (2, "a", "a", "CALLS", 5.0, None)]))
    assert {(r.id, r.type) for r in g.nodes.collect()} == {("a", "Entity"), ("b", "Unknown")}
    assert {r.id for r in g.dependencies("a").collect()} == {"a", "b"} and g.dependents("zzz").count() == 0
    sub = g.subgraph(spark.createDataFrame([("a",), ("nobody",)], "id string"))
    assert sub.nodes.count() == 1 and sub.edges.count() == 1


def test_structural_and_gravity(spark):
    nodes = spark.createDataFrame([(0, "a", "Entity"), (1, "b", "Entity"), (2, "c", "Service")], "node_seq long, id string, type string")
    edges = spark.createDataFrame([("a", "b", "INHERITS", 10.0, ["IMPORTS", "INHERITS"], None), ("c", "a", "IMPORTS", 1.0, ["IMPORTS"], None)], "src string, dst string, type string, weight double, types array<string>, method_name string")
    got = {(r.a, r.b): r for r in weights.pairs(nodes, edges).collect()}
    assert (got["a", "b"].structural, got["a", "b"].gravity) == (1.0, 1.0)
    assert (got["a", "c"].structural, got["a", "c"].gravity) == (pytest.approx(0.05), 0.0)
    back = weights.pairs(nodes.withColumn("node_seq", -F.col("node_seq")), edges)
    assert {(r.a, r.b): r.gravity for r in back.collect()}["b", "a"] == 0.0
    h = weights.hybrid_weights(nodes, edges).collect()
    assert all(0 < r.weight <= 1 for r in h) and len(h) == 2


def test_constraints(spark, two_triangles):
    nodes, w = two_triangles
    found = lambda groups: {r.id: r.super for r in weights.constraint_members(nodes, groups).collect()}
    assert found([["a", "absent"]]) == {"a": "super:0"} and found([["a"]]) == {} and found([["x*"]]) == {}
    assert found([["a", "b"], ["b", "c"]]) == {"a": "super:0", "b": "super:1", "c": "super:1"}
    many = spark.range(20_000).selectExpr("CAST(id + 10 AS INT) AS grp", "concat('n', id, '*') AS pattern").unionByName(spark.createDataFrame([(3, "*"), (5, "a*"), (5, "b")], "grp int, pattern string"))
    assert {r.id: r.super for r in weights.constraint_members(nodes, many).collect()} == {"a": "super:5", "b": "super:5", **dict.fromkeys("cdefg", "super:3")}
    c = weights.contract(w, weights.constraint_members(nodes, [["a", "b"]]))
    assert {(r.a, r.b): r.weight for r in c.collect()}["c", "super:0"] == 2.0
    assert c.agg(F.sum("weight")).first()[0] == w.count() - 1


def test_components(spark, two_triangles):
    nodes, w = two_triangles
    edges = w.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert {r.id: r.component for r in al.weak_components(nodes, edges).collect()} == {**dict.fromkeys("abcdef", "a"), "g": "g"}
    assert al.is_dag(edges)
    cyc = edges.unionByName(spark.createDataFrame([("c", "a"), ("f", "e")], "src string, dst string"))
    got = {r.id: r.component for r in al.strong_components(nodes, cyc).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "g"} and not al.is_dag(cyc)
    assert not al.is_dag(spark.createDataFrame([("a", "a")], "src string, dst string"))


def test_strong_components_of_random_graphs_both_ways(spark, monkeypatch):
    rng = random.Random(8)
    ids = [f"n{i:02d}" for i in range(25)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(38)]
    reach = {v: {v} for v in ids}
    for _ in ids:
        for a, b in links:
            reach[a] |= reach[b]
    want = {v: min(w for w in ids if w in reach[v] and v in reach[w]) for v in ids}
    nodes = spark.createDataFrame([(v,) for v in ids], "id string")
    edges = spark.createDataFrame(links, "src string, dst string")
    assert {r.id: r.component for r in al.strong_components(nodes, edges).collect()} == want
    monkeypatch.setattr(al, "LARGEST", 0)
    assert {r.id: r.component for r in al.strong_components(nodes, edges).collect()} == want


def test_communities(spark, two_triangles, monkeypatch):
    nodes, w = two_triangles
    groups = lambda df: {frozenset(r.ids) for r in df.groupBy("cluster_id").agg(F.collect_list("id").alias("ids")).collect()}
    want = {frozenset("abc"), frozenset("def"), frozenset("g")}
    assert groups(al.detect_communities(nodes, w)) == want
    assert groups(al.detect_communities(nodes, w, "girvan_newman")) == want
    merged = groups(al.detect_communities(nodes, w, constraints=[["a", "f"]]))
    assert any({"a", "f"} <= g for g in merged) and sum(map(len, merged)) == 7
    with pytest.raises(ValueError):
        al.detect_communities(nodes, w, "leiden")
    with pytest.raises(ValueError):
        al.girvan_newman(nodes, w, most_edges=3)
    q = al.modularity(w, al.louvain(nodes, w)).first()[0]
    one = nodes.select("id", F.lit(0).cast("long").alias("cluster_id"))
    assert q > al.modularity(w, one).first()[0] and q == pytest.approx(2 * (3 / 7 - 0.25))
    monkeypatch.setattr(al, "LARGEST", 0)
    spread = groups(al.louvain(nodes, w))
    assert sum(map(len, spread)) == 7


def test_louvain_of_a_large_component_by_moves(spark):
    rng = random.Random(5)
    rows = {(min(a, b), max(a, b)) for g in range(6) for a in range(g * 12, g * 12 + 12) for b in range(g * 12, a) if rng.random() < 0.7}
    rows |= {(g * 12, (g + 1) % 6 * 12 + 1) for g in range(6)}
    w = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in rows], "a long, b long, weight double")
    nodes = spark.range(72).select("id")
    best = al.modularity(w, al.louvain(nodes, w)).first()[0]
    for small in (0, 20):
        moved = al.merge_by_moves(w, 2.0 * len(rows), small=small)
        found = al.number_clusters(nodes, moved)
        assert found.count() == 72 and al.modularity(w, found).first()[0] >= 0.9 * best > 0.5


def test_hierarchies_are_walked_to_the_end(spark):
    from lattica.operators import hierarchy

    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(16)], "id string, parent string")
    assert hierarchy.ancestors(chain).where("id = 'c0'").agg(F.max("depth")).first()[0] == 16


def test_unsettled_strong_components_raise(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (2, 3)], "src long, dst long")
    with pytest.raises(RuntimeError):
        al._colouring(edges, "bigint", rounds=1)


def test_report_by_hand(spark):
    nodes = spark.createDataFrame([(0, "p.OwnerEntity", "Entity", 3, "p", "OwnerEntity"), (1, "p.B", "Service", 2, "p", "B"), (2, "q.C", "Unknown", 1, "q", "C"), (3, "q.D", "Service", 0, "q", "D")], "node_seq long, id string, type string, complexity_score int, package string, simple_name string")
    edges = spark.createDataFrame([("p.OwnerEntity", "p.B"), ("p.B", "p.OwnerEntity"), ("p.B", "q.C")], "src string, dst string").withColumn("type", F.lit("CALLS")).withColumn("weight", F.lit(5.0)).withColumn("method_name", F.lit(None).cast("string"))
    a = spark.createDataFrame([("p.OwnerEntity", 0), ("p.B", 0), ("q.C", 1), ("q.D", 2)], "id string, cluster_id long")
    r = {x.cluster_id: x for x in cl.cluster_report(nodes, edges, a).collect()}
    assert (r[0].internal_cohesion, r[0].external_coupling, r[0].complexity_score, r[0].dominant_type, r[0].base_name) == (2.0, 0.5, 5, "Entity", "owner-service")
    assert (r[1].internal_cohesion, r[1].external_coupling, r[1].base_name) == (0.0, 1.0, "q-service") and r[0].entities == ["p.OwnerEntity"]
    names = cl.dedup_names(cl.cluster_report(nodes, edges, a), "base_name", "cluster_id").select("cluster_id", "name")
    assert {x.cluster_id: x.name for x in names.collect()} == {0: "owner-service", 1: "q-service", 2: "q-service-2"}
    b = cl.boundary_edges(edges, a, names).collect()
    assert [(x.from_service, x.to_service) for x in b] == [("owner-service", "q-service")]
    full = spark.createDataFrame([(0, "m.Owner", "Entity"), (1, "m.OwnerController", "Controller"), (2, "m.OwnerRepository", "Unknown")], "node_seq long, id string, type string")
    s = cl.stack_report(full, edges, full.select("id", F.lit(0).cast("long").alias("cluster_id"))).first()
    assert s.internal_cohesion == 1.0 and s.packages == 1


def test_names_never_collide(spark):
    rows = spark.createDataFrame(list(enumerate(["x", "x-2", "x", "x", "y", "x-3", "y"])), "s long, b string")
    got = [r.name for r in cl.dedup_names(rows, "b", "s").orderBy("s").collect()]
    assert len(set(got)) == 7 and got[0] == "x" and got[4] == "y" and got[6] == "y-2"


def test_leftovers_chunks_and_sequential_ids(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    got = merge.sequential_ids(rows, ["k"], "i", start=5, part_rows=100).collect()
    assert {r.k: r.i for r in got} == {k: k + 5 for k in range(1000)}
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "node_seq long, id string")
    a = cl.with_leftovers(nodes, spark.createDataFrame([("n1", 7)], "id string, cluster_id long"))
    assert {r.id: r.cluster_id for r in a.collect()} == {"n1": 7, "n0": 8, "n2": 9, "n3": 10, "n4": 11}


def test_json_and_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a&b", "Entity", ["X"]), (1, "c", None, None)], "node_seq long, id string, type string, annotations array<string>")
    edges = spark.createDataFrame([("a&b", "c", "CALLS", 5.0, ["CALLS"], None)], "src string, dst string, type string, weight double, types array<string>, method_name string")
    g = CodeGraph(nodes, edges)
    g.export(str(tmp_path / "g.json"))
    doc = json.loads((tmp_path / "g.json").read_text())
    assert doc["nodes"][0]["annotations"] == ["X"] and doc["edges"] == [{"source": "a&b", "target": "c", "type": "CALLS", "weight": 5.0, "types": ["CALLS"]}]
    back = CodeGraph.from_json(spark, str(tmp_path / "g.json"))
    assert back.nodes.count() == 2 and back.edges.first().weight == 5.0
    g.export(str(tmp_path / "g.graphml"), "graphml")
    import xml.etree.ElementTree as ET

    root = ET.parse(tmp_path / "g.graphml").getroot()
    assert len(list(root.iter("{http://graphml.graphdrawing.org/xmlns}node"))) == 2
    with pytest.raises(ValueError):
        g.export(str(tmp_path / "x"), "png")
    n, e = back.render_tables()
    assert n.where("id = 'c'").first()["size"] == 10 and e.first().width == 2.5
    s = CodeGraph(nodes, edges).statistics().first()
    assert (s.node_count, s.edge_count, s.is_dag, s.strongly_connected_components, s.weakly_connected_components) == (2, 1, True, 2, 1)


def test_find_similar_blocks_ties_and_odd_vectors(spark, monkeypatch):
    import math

    from lattica.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0 - i % 2]) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [2.0, None, 1.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = [0, 7, 11, 13, 39, 100, 101, 102]
    got = {}
    for r in vectors.find_similar(v, v.where(v.id.isin(asked)), 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, None if r.similarity is None else round(r.similarity, 9)))
    good = {i: x for i, x in rows if i < 40}
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y)
    assert sorted(got) == sorted(asked) and all(sorted(got[q]) == [(n + 1, i, None) for n, i in enumerate([0, 1, 2, 3])] for q in (100, 101, 102))
    for q in (0, 7, 11, 13, 39):
        found = got[q]
        want = sorted((-round(cos(good[q], x), 9), i) for i, x in good.items() if i != q)[:4]
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    assert vectors.find_similar(v.limit(0), v, 4).count() == 0 and len(vectors.find_similar(v.where("id < 3 OR id = 100"), v.where("id = 0"), 9).collect()) == 3


def test_ledger_streams_each_budget_in_order(spark):
    import random

    from lattica.operators import ledger

    random.seed(5)
    rows = [(b, s, float(random.randint(0, 9)), float(random.randint(0, 9))) for b in ("x", "y", None) for s in range(400)] + [("x", 400, None, 1.0)]
    random.shuffle(rows)
    got = {(r.budget, r.seq): (r.accepted, r.total) for r in ledger.greedy_accept(spark.createDataFrame(rows, "budget string, seq long, estimate double, cost double"), 50.0).collect()}
    assert len(got) == len(rows)
    for b in ("x", "y", None):
        total = 0.0
        for _, s, e, c in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]):
            ok = e is not None and total + e <= 50 and total + c <= 50
            total += c if ok else 0
            assert got[b, s] == (ok, total)


def test_single_service_and_first_calls(spark):
    from lattica.operators import clusters

    n = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "node_seq long, id string")
    none = spark.createDataFrame([], "service_index long, name string, classes array<string>")
    assert {r.cluster_id for r in clusters.proposal_assignment(n, clusters.readable_proposal(n, none)).collect()} == {0}
    some = spark.createDataFrame([(3, "s", ["c1"])], none.schema)
    assert clusters.readable_proposal(n, some).collect() == some.collect()
    b = spark.createDataFrame([("a", "b", "k.X", "k.Y", None, "CALLS", 9), ("a", "b", "k.Z", "k.Y", "m", "CALLS", 2), ("a", "b", "k.W", "k.Y", "n", "CALLS", 5)], "from_service string, to_service string, from_class string, to_class string, method string, edge_type string, seq long")
    r = clusters.first_calls(b).first()
    assert (r.from_class, r.method, r.calls, r.priority) == ("k.Z", "m", 3, "MEDIUM")
    assert clusters.first_calls(b.drop("seq")).first().from_class == "k.W"
