import re
import zlib

import numpy as np
import zstandard as zs
from pyspark.sql import functions as F

from lattica.llm import op8_toxicity as t


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = docs.join(labels.select("doc_id"), "doc_id", "left_semi")  # the labelled part of the table, for time
    got = t.train(judged, labels).score(judged).join(labels, "doc_id").toPandas()
    got = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    hit = (got.score >= 0.5).astype(int)
    assert (hit == got.toxic).mean() > 0.96 and hit[got.toxic == 1].mean() >= 0.9 and (1 - hit)[got.toxic == 0].mean() > 0.97


def brute_score(text, model):
    """A score in plain Python: a compressor for each window, no memory between windows."""
    def size(window, content):
        shape = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, min_match=4, hash_log=16, chain_log=16, search_log=6, window_log=17, write_checksum=0, write_content_size=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=shape)
        return len(zs.ZstdCompressor(dict_data=d, compression_params=shape).compress(b" " + window + b" " + t.TAIL))

    words = [w for w in re.split(r"[\x00-\x2f:-@\[-`{-\x7f]+", (text or "").lower()) if w] or [""]
    gain = {w: size(w.encode(), model.contents[0]) - size(w.encode(), model.contents[1]) for w in set(words)}
    length = {w: len(w.encode()) + 2 for w in gain}
    top = sorted(gain.values(), reverse=True)[:3]
    rate = sorted((gain[w] / length[w] for w in gain), reverse=True)[:3]
    hits = sum(2 * gain[w] >= length[w] for w in words)
    x = np.array([*top, *top[-1:] * (3 - len(top)), *rate, *rate[-1:] * (3 - len(rate)), np.log(len(words)), hits / len(words) ** 0.5])
    mean, spread, weight = model.curve
    z = (x - mean) / spread
    return 1 / (1 + np.exp(-np.clip(np.concatenate([[1], z, z[:6] ** 2, z * z[6]]) @ weight, -30, 30)))


def test_scores_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 9 = 0 OR doc_id IN (SELECT doc_id FROM parquet.`/root/testdata/sf0.01/labels.parquet`)")
    model = t.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.curve is not None
    some = docs.where("doc_id % 9 = 0 AND length(text) < 3000")
    texts = {r.doc_id: r.text for r in some.collect()}
    got = {r.doc_id: r.score for r in model.score(some).collect()}
    assert len(got) == len(texts) > 50 and all(abs(got[i] - brute_score(x, model)) < 1e-9 for i, x in texts.items())


def test_query_covers_every_row(spark, sf_dir):
    got = t.query(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))


def test_hard_rows_and_few_labels(spark):
    rows = [(i, f"plain words number {i} and some more text of no note", 0) for i in range(40)] + [(100 + i, f"you scoundrel number {i} and some more text", 1) for i in range(40)] + [(None, "scoundrel", 0), (200, None, 0), (201, "", 0), (202, "scoundrel " * 50_000, 0), (202, "scoundrel", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.where("doc_id < 200").select("doc_id", F.col("score").alias("toxic"))
    model = t.train(docs, labels)
    got = model.score(docs).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got[got.doc_id.between(100, 139)].score >= 0.5).mean() > 0.9 and (got[got.doc_id < 100].score < 0.5).mean() > 0.9
    assert model.keep(docs).columns == docs.columns
    assert t.train(docs, labels.limit(0)).score(docs).toPandas().score.eq(0).all()
    assert model.score(docs.limit(0)).count() == 0 and model.keep(docs.limit(0)).count() == 0
