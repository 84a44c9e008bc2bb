import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import op10_mixing as m


def test_targets():
    assert m.targets([10, 10, 10], [5, 2, 1]) == [pytest.approx(18.75), pytest.approx(7.5), pytest.approx(3.75)]
    got = m.targets([1, 100, 0, 50], [5, 2, 1, 5])
    assert got[0] == 3 and got[2] == 0 and sum(got) == pytest.approx(151) and got[1] / 2 == pytest.approx(got[3] / 5)
    assert m.targets([], []) == [] and m.targets([0, 0], [1, 1]) == [0, 0]


def test_query(spark, sf_dir):
    got = m.query(spark, sf_dir).toPandas()
    again = m.query(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").toPandas()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in zip(docs.doc_id, docs.text)}
    got["source"] = got.doc_id.map(dict(zip(docs.doc_id, docs.source)))
    assert all(words[i] == s for i, s in zip(got.doc_id, got["size"]))
    names = sorted(set(docs.source))
    sizes = got.groupby("source")["size"].sum()
    want = m.targets([float(sizes[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, t in zip(names, want):
        own = got[got.source == n]
        assert own.target.iloc[0] == pytest.approx(t) and (own.source_size == sizes[n]).all()
        assert abs(own.taken.sum() - t) <= own["size"].max() / 2 + 1e-6
        assert (own.taken <= 3 * own["size"]).all()


def test_pareto_order_by_brute_force(spark):
    docs = spark.createDataFrame([(i, "s", "w " * (1 + i % 9)) for i in range(500)] + [(1000 + i, "t", "w " * 4) for i in range(100)] + [(2000, None, "a b"), (2001, None, None), (None, "s", "q")], "doc_id long, source string, text string")
    got = m.mix(docs).withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(10)), 2) + 0.5) / float(1 << 62)).toPandas()
    for name in ("s", "t"):
        own = got[got.source == name]
        rate = own.mix_target.iloc[0] / own.mix_source_size.iloc[0]
        extra = own.mix_copies - int(rate + 1e-12)
        assert set(extra) <= {0, 1}
        if 0 < extra.sum() < len(own):
            assert own.u[extra == 1].max() < own.u[extra == 0].min()
    assert got[got.source.isna()].mix_copies.max() <= 3 and got[got.mix_size == 0].mix_copies.max() == 0


def test_rates_and_inclusion_of_unequal_sizes(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else "t", "w " * (50, 100, 400, 900, 5000)[i % 5]) for i in range(6000)], "doc_id long, source string, text string")
    got = m.mix(docs, weights=(1.0, 6.0), preference=m.by_length).toPandas()
    got["pref"] = got.mix_size.map({50: 0.5, 100: 0.5, 400: 1.0, 900: 2 ** (round(8 * 0.5849625) / 8), 5000: 2.0})
    for _, own in got.groupby("source"):
        target = own.mix_target.iloc[0]
        lo, hi = 0.0, 1e6  # the rate, by bisection
        for _ in range(200):
            rate = (lo + hi) / 2
            lo, hi = (rate, hi) if ((rate * own.pref).clip(upper=3) * own.mix_size).sum() < target else (lo, rate)
        for size, some in own.groupby("mix_size"):
            assert some.mix_copies.mean() == pytest.approx(min(3, rate * some.pref.iloc[0]), abs=0.06), size
        assert abs((own.mix_copies * own.mix_size).sum() - target) <= own.mix_size.max()
    odd = docs.limit(40).withColumn("p", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, float("nan")).when(F.col("doc_id") % 4 == 2, -1.0).otherwise(float("inf")))
    assert m.mix(odd, preference=F.col("p")).count() == 40


def test_extra_columns_ties_and_long_texts(spark):
    rows = [(1, "s", "w " * 200_000, "x"), (2, "s", "a b", "y"), (2, "s", "a b", "y"), (3, None, None, None), (None, None, "q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_row string")
    got = m.mix(docs, preference=m.by_length)
    assert got.columns[:4] == docs.columns
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].mix_size == 200_000 and by_id[3].mix_size == 0 and by_id[3].mix_copies == 0
    assert len({r.mix_copies for r in got.collect() if r.doc_id == 2}) == 1


def test_preference_copies_and_empty(spark):
    docs = spark.createDataFrame([(i, "s" if i % 2 else "t", "w " * 10, i % 4 + 1) for i in range(800)], "doc_id long, source string, text string, mix_no int")
    got = m.mix(docs, preference=F.col("mix_no")).toPandas()
    for _, own in got.groupby("source"):
        assert abs((own.mix_copies * own.mix_size).sum() - own.mix_target.iloc[0]) <= 10
        assert own.groupby("mix_no").mix_copies.mean().is_monotonic_increasing
    assert m.mixed(docs).columns == docs.columns and m.mixed(docs).count() == int(m.mix(docs).agg(F.sum("mix_copies")).first()[0])
    assert m.mix(docs.limit(0)).count() == 0 and m.mixed(docs.limit(0)).count() == 0
