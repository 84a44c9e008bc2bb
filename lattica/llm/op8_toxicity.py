"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are made of labelled texts. The ordinary one is what zstandard's trainer picks from ordinary texts. The toxic one is the same
content and, after it, the windows that recur in toxic texts at over ``RATIO`` times their rate in ordinary ones. A text is cut into windows of
words; a window's gain is the bytes that the toxic dictionary saves over the ordinary one. Since the dictionaries differ in the toxic part
only, the gain is near zero but for windows that toxic texts share. A logistic curve over the largest gains, the largest gains by
length, the share of clear gains and the text's length is fitted on labelled texts, each class weighing what it weighs among all labels; it gives a score whose
threshold is 0.5. The curve is cross-fitted: each half of the labelled texts is measured by dictionaries made of the other half, so no text is judged by windows that it gave itself.

Windows of several words and a toxic dictionary that the trainer picks were tried and are measured in the README: they find fewer toxic texts.

Labels are used of rows whose crc32(id) mod 5 is not 0. Training takes a bounded sample of those (``MAX_TOXIC`` and ``MAX_ORDINARY`` documents, the first in the order of a hash of
the id, and of each class ``MAX_BYTES`` of text at most, whole texts only); every other step covers all rows. A score depends on the text alone.

Defined results: null and empty texts are scored like any text (no gains); a very long text is scored by all its windows; equal texts and repeated rows score alike; ties at 0.5 are toxic; a null id is scored and is not
held out; with no label of either class every score is the share of toxic labels (0 without labels); an empty table gives an empty table. Extra columns are ignored,
and ``keep`` passes them through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidied

#: Labelled documents that training takes at most.
MAX_TOXIC, MAX_ORDINARY = 3000, 9000
#: Bytes of labelled text of each class that come to the driver at most.
MAX_BYTES = 40_000_000
#: Words in a window.
WINDOW = 1
#: Bytes of ordinary content in both dictionaries, and of toxic windows at most.
BASE, EXTRA = 15_000, 8_000
#: A toxic window must recur in this share of the toxic texts, and in four, so many times as often as in ordinary ones.
RECURS, RATIO = 0.012, 20
#: A toxic text that shares this part of its new windows with those before it is a copy and counts no window again.
COPIED = 0.5
#: Ends every window: bytes that both dictionaries hold, so that matches are sought up to the window's end.
TAIL = bytes(range(128, 160))
SPLIT = re.compile(rb"[\x00-\x2f:-@\[-`{-\x7f]+")
#: Fewer texts of a class than this are not cross-fitted.
LEAST_CALIBRATION = 30


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The text's windows, lower case, with ASCII punctuation as spaces."""
    words = SPLIT.sub(b" ", (text or "").lower().encode()).strip().split(b" ")
    return words if size == 1 else [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the (ordinary, toxic) dictionaries."""
    plain = [b" ".join(windows(t)) for t in dict.fromkeys(ordinary)]
    try:
        base = zs.train_dictionary(BASE + 2000, plain, k=200, d=8).as_bytes()[-BASE:]
    except zs.ZstdError:  # too few or too short texts to train on: their own content serves
        base = b" ".join(plain)[:BASE]
    often: Counter[bytes] = Counter()
    for t in dict.fromkeys(ordinary):
        often.update(set(windows(t)))
    found: Counter[bytes] = Counter()
    texts = 0
    for t in dict.fromkeys(toxic):
        own = set(windows(t))
        new = [w for w in own if w not in often]
        if len(new) < 8 or sum(w in found for w in new) < COPIED * len(new):
            found.update(own)
            texts += 1
    least = max(4, int(texts * RECURS))
    found = Counter({w: n for w, n in found.items() if len(w) > 2 and n * len(plain) >= RATIO * often[w] * texts})
    picked, size = [], 0
    for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if n < least or size + len(w) > EXTRA:
            break
        picked.append(w)
        size += len(w) + 1
    return TAIL + base + TAIL, TAIL + base + b" " + b" ".join(reversed(picked)) + b" " + TAIL


class Gains:
    """Compresses windows with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        shape = zs.ZstdCompressionParameters(
            strategy=zs.STRATEGY_LAZY2, min_match=4, hash_log=16, chain_log=16, search_log=6, window_log=17,
            write_checksum=0, write_content_size=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
        )
        self.compress = []
        for content in (ordinary, toxic):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=shape)
            self.compress.append(zs.ZstdCompressor(dict_data=d, compression_params=shape).compress)
        self.seen: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        g = self.seen.get(window)
        if g is None:
            if len(self.seen) > 120_000:
                self.seen.clear()
            framed = b" " + window + b" " + TAIL
            ordinary, toxic = self.compress
            g = self.seen[window] = len(ordinary(framed)) - len(toxic(framed))
        return g

    def features(self, text: str | None) -> list[float]:
        every = windows(text)
        gains = [(self.gain(w), len(w) + 2) for w in set(every)]
        most = sorted((g for g, _ in gains), reverse=True)[:3]
        rates = sorted((g / n for g, n in gains), reverse=True)[:3]
        clear = {w for w in set(every) if 2 * self.gain(w) >= len(w) + 2}
        hits = sum(w in clear for w in every) if clear else 0
        return [*most, *most[-1:] * (3 - len(most)), *rates, *rates[-1:] * (3 - len(rates)), np.log(len(every)), hits / len(every) ** 0.5]


N_FEATURES = 8


def _terms(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = (x - mean) / spread
    return np.hstack([np.ones((len(z), 1)), z, z[:, :6] ** 2, z * z[:, 6:7]])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features and the curve's weights, by ridge logistic regression."""
    weight = weight / weight.sum()
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a, ridge = _terms(x, mean, spread), max(1e-4, 1 / len(y))
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return mean, spread, w


def _map_features(rows: DataFrame, id_col: str, contents: tuple[bytes, bytes], curve=None) -> DataFrame:
    """(id, score) by the curve, or (id, features)."""

    def run(batches):
        gains = Gains(*contents)
        for b in batches:
            x = np.array([gains.features(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, N_FEATURES)
            if curve is None:
                out = pa.array(list(x), pa.list_(pa.float64()))
            else:
                out = pa.array(1 / (1 + np.exp(-np.clip(_terms(x, curve[0], curve[1]) @ curve[2], -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["id", "out"])

    kind = "array<double>" if curve is None else "double"
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col("text")).mapInArrow(tidied(run), f"id long, out {kind}")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


class Model:
    """Trained dictionaries and curve; or, without enough labels, one share for all."""

    def __init__(self, share: float, contents: tuple[bytes, bytes] | None = None, curve=None):
        self.share, self.contents, self.curve = share, contents, curve

    def score(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, score) for each row."""
        rows = docs.select(F.col(id_col), F.col(text).alias("text"))
        if self.curve is None:
            return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(float(self.share)).alias("score"))
        return _map_features(rows, id_col, self.contents, self.curve).select(F.col("id").alias("doc_id"), F.col("out").alias("score"))

    def keep(self, docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
        """docs without the texts that score at or above the threshold, by one pass over the rows."""
        if self.curve is None:
            return docs if self.share < threshold else docs.limit(0)
        contents, curve, at = self.contents, self.curve, docs.columns.index(text)

        def run(batches):
            gains = Gains(*contents)
            for b in batches:
                x = np.array([gains.features(t.as_py()) for t in b.column(at)], np.float64).reshape(-1, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(_terms(x, curve[0], curve[1]) @ curve[2], -30, 30)))
                yield b.filter(pa.array(p < threshold))

        return docs.mapInArrow(tidied(run), docs.schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows of docs that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(8))
    # Ids only, and at most the two bounds of them.
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    picked = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), "y")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    fold, third = (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).alias(name) for salt, n, name in ((9, 2, "fold"), (10, 3, "third")))
    sample = materialize(rows.select("doc_id", "text", "y", F.octet_length("text").cast("long").alias("bytes"), order.alias("order"), fold, third).dropDuplicates(["doc_id"]), "labelled")
    of_all = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # At most the two bounds of ids, and of their texts what fits MAX_BYTES; a longer text than is left is passed over.
    left, fits = [MAX_BYTES, MAX_BYTES], []
    for r in sample.select("doc_id", "y", "bytes").orderBy("order", "doc_id").collect():
        if r["bytes"] <= left[r["y"]]:
            left[r["y"]] -= r["bytes"]
            fits.append((r["doc_id"],))
    if not fits:
        return Model(0.0)
    sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long")), "doc_id")
    got = sample.select("doc_id", "text", "y", "fold", "third").orderBy("doc_id").collect()
    n = [sum(r["y"] == y for r in got) for y in (0, 1)]
    if min(n) < 2:
        return Model(n[1] / sum(n))
    texts = lambda y, other: [r["text"] for r in got if r["y"] == y and r["fold"] != other]
    least = min(sum(r["y"] == y and r["fold"] == k for r in got) for y in (0, 1) for k in (0, 1))
    folds = (0, 1) if least >= LEAST_CALIBRATION else (None,)
    x: dict[int, list[float]] = {}
    for k in folds:
        judged = sample.where((F.col("y") == 1) | (F.col("third") == 0) | F.lit(k is None))
        judged = judged if k is None else judged.where(F.col("fold") == k)
        x |= {r["id"]: r["out"] for r in _map_features(judged, "doc_id", train_dictionaries(texts(1, k), texts(0, k))).collect()}
    y = {r["doc_id"]: r["y"] for r in got}
    ids = sorted(x)
    ys = np.array([y[i] for i in ids], np.float64)
    share = [of_all.get(k, 0) / max(1, (ys == k).sum()) for k in (0, 1)]
    curve = calibrate(np.array([x[i] for i in ids]), ys, np.where(ys == 1, share[1], share[0]))
    return Model(0.0, train_dictionaries(texts(1, None), texts(0, None)), curve)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = train(docs, labels).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
