import random
from collections import defaultdict, deque

from lattica.operators import algorithms as al


def _components(ids: list, near: dict) -> list[list]:
    seen, out = set(), []
    for v in ids:
        if v not in seen:
            seen.add(v)
            part, queue = [v], deque([v])
            while queue:
                for w in near[queue.popleft()]:
                    if w not in seen:
                        seen.add(w)
                        part.append(w)
                        queue.append(w)
            out.append(part)
    return out


def betweenness_split(ids: list, links: list[tuple]) -> list[list]:
    """The parts after edges of the highest betweenness are cut, one at a time, until there is a part more."""
    near: dict = {v: set() for v in ids}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    start = len(_components(ids, near))
    while any(near.values()):
        score: dict = defaultdict(float)
        for s in ids:
            order, parents, paths, depth = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for w in sorted(near[v]):
                    if w not in depth:
                        depth[w] = depth[v] + 1
                        queue.append(w)
                    if depth[w] == depth[v] + 1:
                        paths[w] += paths[v]
                        parents[w].append(v)
            credit: dict = defaultdict(float)
            for w in reversed(order):
                for v in parents[w]:
                    c = paths[v] / paths[w] * (1 + credit[w])
                    score[min(v, w), max(v, w)] += c
                    credit[v] += c
        most = max(score.values())
        a, b = min(e for e, x in score.items() if x >= most - 1e-9)
        near[a].discard(b)
        near[b].discard(a)
        parts = _components(ids, near)
        if len(parts) > start:
            return parts
    return [[v] for v in ids]


def links(spark, pairs):
    return spark.createDataFrame([(*sorted(p), 1.0) for p in pairs], "a string, b string, weight double").coalesce(1)


def brute_scores(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    score = defaultdict(float)
    for s in near:
        depth, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
        done = []
        while order:
            v = order.popleft()
            done.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        credit = defaultdict(float)
        for w in reversed(done):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    c = paths[v] / paths[w] * (1 + credit[w])
                    score[tuple(sorted((v, w)))] += c / 2
                    credit[v] += c
    return score


def test_betweenness_of_random_graphs(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample([f"n{i:02d}" for i in range(14)], 2))) for _ in range(22)} | {("x1", "x2")}
    want = brute_scores(pairs)
    for rows in (20_000_000, 130):  # one batch of sources, and several
        got = {(r.a, r.b): r.score for r in al.edge_betweenness(links(spark, pairs).select("a", "b"), rows=rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_first_split(spark):
    rng = random.Random(9)
    for edges in (9,):
        ids = [f"n{i:02d}" for i in range(9)]
        pairs = {tuple(sorted(rng.sample(ids[:7], 2))) for _ in range(edges)}
        nodes = spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1)
        got = defaultdict(set)
        for r in al.girvan_newman(nodes, links(spark, pairs)).collect():
            got[r.cluster_id].add(r.id)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in betweenness_split(ids, sorted(pairs))}


def test_a_long_cycle_shrinks_by_elimination(spark, monkeypatch):
    n = 1_000
    edges = spark.range(n).selectExpr("id AS src", "(id + 1) % 1000 AS dst").unionByName(spark.range(1).selectExpr("id + 17 AS src", "id + 5000 AS dst")).unionByName(spark.range(1).selectExpr("id + 5000 AS src", "id + 5001 AS dst"))
    core, taken = al.eliminate(edges, 200)
    assert core.count() <= 200 and len(taken) < 15
    monkeypatch.setattr(al, "LARGEST", 200)
    nodes = edges.selectExpr("src AS id").unionByName(edges.selectExpr("dst AS id")).distinct()
    got = {r.component: r.n for r in al.strong_components(nodes, edges).groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert got == {0: 1000, 5000: 1, 5001: 1}
