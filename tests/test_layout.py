import random
from functools import cache

from lattica.operators import layout


def test_layers_against_brute_force(spark):
    rng = random.Random(3)
    ids = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rng.sample(ids, 2))) for _ in range(45)}
    cycle = {("n05", "n06"), ("n06", "n05")}  # one node of the longest path
    nodes = spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1)
    edges = spark.createDataFrame([*pairs | cycle, ("n01", "n01"), ("n01", "unknown")], "src string, dst string").coalesce(1)
    of = lambda x: "n05" if x == "n06" else x
    dag = {(of(a), of(b)) for a, b in pairs if of(a) != of(b)}

    @cache
    def depth(x):
        return max([depth(a) + 1 for a, b in dag if b == x], default=0)

    got = {r.id: r.layer for r in layout.layers(nodes, edges).collect()}
    assert got == {x: depth(of(x)) for x in ids}
    placed = layout.layered(nodes, edges, sweeps=2)
    assert {r.id: int(r.y) for r in placed.collect()} == got
    by_layer = {}
    for r in placed.collect():
        by_layer.setdefault(r.y, []).append(r.x)
    assert all(sorted(v) == [(i + 0.5) / len(v) for i in range(len(v))] for v in by_layer.values())


def test_forces_shorten_edges(spark):
    nodes = spark.range(120).selectExpr("CAST(id AS STRING) AS id").coalesce(1)
    edges = spark.range(120).selectExpr("CAST(id AS STRING) AS src", "CAST(CASE WHEN id % 40 = 39 THEN id - 39 ELSE id + 1 END AS STRING) AS dst").coalesce(1)  # three rings
    start = layout.stretch(layout.force(nodes, edges, rounds=0), edges).first()[0]
    end = layout.stretch(layout.force(nodes, edges, rounds=12), edges).first()[0]
    assert 0.8 < start < 1.2 and end < 0.6 * start
