import numpy as np
from pyspark.sql import functions as F

from lattica.llm import op3_ann as a


def brute(ids, x, queries, k=5):
    out = {}
    for q in queries:
        s = a.cosines(x[ids.index(q)], x)
        out[q] = [(ids[i], s[i]) for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
    return out


def test_recall_and_scores(spark, sf_dir):
    got = a.query(spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = list(rows.vec_id), np.array(rows.embedding.tolist(), np.float64)
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    hit = 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hit += len(set(mine.vec_id) & {i for i, _ in near})
        for v, s in zip(mine.vec_id, mine.score):
            assert abs(s - a.cosines(x[ids.index(q)], x[[ids.index(v)]])[0]) < 1e-12
    assert hit / (5 * len(want)) >= 0.9


def test_recall_over_several_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(a, "BLOCK", 100)
    monkeypatch.setattr(a, "QUERIES", 7)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 24))
    x = centers[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = a.search(df, F.col("vec_id") % 50 == 0).toPandas()
    want = brute(list(range(3000)), x, range(0, 3000, 50))
    hit = sum(len(set(got[got.query_id == q].vec_id) & {i for i, _ in near}) for q, near in want.items())
    assert hit / (5 * len(want)) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    v, w = [1.0, 0.0, 2.0], [0.0, 1.0, 0.5]
    rows = [(i, v) for i in range(0, 40)] + [(100, w), (101, [0.0, 2.0, 1.0]), (150, None), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 0.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0]), (400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, [2.0, 1.0]), (None, v), (0, v), (7, w)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = a.search(df, F.col("vec_id") % 50 == 0).collect()
    of = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [1, 2, 3, 4, 5]  # 7 counts as its smaller vector
    assert of(100)[:2] == [7, 101] and len(of(100)) == 5 and of(100)[2:] == [0, 1, 2]
    assert of(400) == [401, 402]  # another length
    assert {r.query_id for r in got} == {0, 100, 400}
    assert a.search(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, v), (1, w)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in a.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_no_loss_in_clusters_finer_than_codes_and_cells(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 24))
    x = centers[np.arange(6000) % 40] + 1e-5 * rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = a.search(df, F.col("vec_id") % 50 == 0, cells=4).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 6000, 50):  # cosines there agree in ten digits: by distance
        far = np.linalg.norm(u - u[q], axis=1)
        assert far[got[got.query_id == q].vec_id].max() <= np.sort(far)[5] + 1e-7


def test_no_loss_beyond_the_cells_visited_first(spark, monkeypatch):
    monkeypatch.setattr(a, "PROBE_LEAST", 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = a.search(df, F.col("vec_id") % 50 == 0, probe_recall=0.1).toPandas()
    for q, near in brute(list(range(3000)), x, range(0, 3000, 50)).items():
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == [i for i, _ in near]
