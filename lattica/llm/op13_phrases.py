"""Phrases whose words occur together more often than apart, per language.

n-grams are exploded into rows level by level, counted by hash aggregation, joined with the counts of their parts, scored in Decimal, anti-joined with their one-word extensions and ranked by a window.

Every part of a phrase is at least as frequent as the phrase, so an n-gram is made a row only if its parts reach the least count; nothing else is left out, and counts are exact.
Texts are gathered in chunks of bounded size, one language each, as numbers of the chunk's own words. A chunk sends its distinct words with their counts and gets back which are frequent;
sends its distinct pairs of those and gets back which are frequent; and then sends the longer n-grams of which all pairs are. So a key has at most one row for each chunk, however hot it is, and no dictionary is broadcast.

Defined results: a null or empty text has no words; a null language is ``und``. Rows with equal or null ids are counted each (ids aren't used). Very long texts are taken whole. Ties of score and count are ordered by the phrase's UTF-8 bytes.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidied
from .words import Words, pieces_of

MAX_N = 4
MIN_COUNT = 30
KEPT_IN = 80
TOP = 2000
#: Bytes of text in a chunk, and in all chunks that a task holds open.
CHUNK, OPEN = 16 << 20, 32 << 20

#: Bytes that end a piece; words are also parted by space and tab.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, -1 between pieces, and the distinct words. data: bytes in lower case."""
    words = Words(data, offsets, b"\x20\x09" + ENDS)
    if not len(words.ids):
        return np.zeros(0, np.int32), words.distinct
    ends = np.zeros(256, bool)
    ends[np.frombuffer(ENDS, np.uint8)] = True
    passed = np.cumsum(ends[data], dtype=np.int64)
    cut = passed[words.begins[1:]] != passed[words.ends[:-1] - 1]
    cut[words.first[(words.first > 0) & (words.first < len(words.ids))] - 1] = True
    out = np.full(len(words.ids) + int(cut.sum()), -1, np.int32)
    out[np.arange(len(words.ids)) + np.concatenate([[0], np.cumsum(cut)])] = words.ids
    return out, words.distinct


def _lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


CHUNKS = "chunk long, lang string, tokens binary, local int, word string, count long"


def _chunked(chunk_bytes: int, open_bytes: int):
    """(lang, text) -> for each chunk a row of its tokens and one for each distinct word."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("tokens", pa.binary()), ("local", pa.int32()), ("word", pa.string()), ("count", pa.int64())])

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        made = 0

        def flush(lang):
            nonlocal made
            texts = held.pop(lang)
            size.pop(lang)
            offsets = np.cumsum([0] + [len(t) for t in texts])
            tokens, distinct = tokens_of(np.concatenate(texts), offsets)
            if not len(tokens):
                return
            chunk = (part << 32) + made
            made += 1
            n = len(distinct)
            packed = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes())
            counts = np.bincount(tokens[tokens >= 0], minlength=n)
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "lang": [lang], "tokens": [packed], "local": [None], "word": [None], "count": [None]}, schema)
            for lo in range(0, n, 100_000):
                some = distinct.slice(lo, 100_000)
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), pa.array([lang] * k), pa.nulls(k, pa.binary()), pa.array(np.arange(lo, lo + k, dtype=np.int32)), some.cast(pa.large_string()).cast(pa.string()), pa.array(counts[lo : lo + k])], schema=schema)

        for b in batches:
            for rows, data, offsets in pieces_of(b, 1):
                data = _lower(data)
                for lang, lo, hi in zip(rows.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                    if hi == lo:
                        continue
                    if size.get(lang, 0) + hi - lo > chunk_bytes and lang in held:
                        yield from flush(lang)
                    held.setdefault(lang, []).append(data[lo:hi].copy())
                    size[lang] = size.get(lang, 0) + int(hi - lo)
                while sum(size.values()) > open_bytes:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return tidied(run)


def _unpacked(table: pa.Table) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(table["tokens"][0].as_py()), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()


def _named(table: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a chunk's frequent words in its text, -1 for all else, and their ids in order."""
    tokens = _unpacked(table)
    ids, place = np.unique(words["id"].to_numpy(), return_inverse=True)
    to = np.full(int(max(tokens.max(), words["local"].to_numpy().max(initial=-1))) + 2, -1, np.int64)
    to[words["local"].to_numpy()] = place
    return to[tokens], ids  # -1 takes the last place, which holds -1


def _counted(left: np.ndarray, right: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, count = np.unique(left * base + right, return_counts=True)
    return keys // base, keys % base, count


def _pair_rows(texts: pa.Table, words: pa.Table) -> pa.Table:
    """Distinct pairs of neighbouring frequent words of a chunk, with counts."""
    schema = pa.schema([("chunk", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("count", pa.int64())])
    if not texts.num_rows or not words.num_rows:
        return schema.empty_table()
    at, ids = _named(texts, words)
    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    x, y, count = _counted(at[both], at[both + 1], len(ids))
    return pa.table([pa.array(np.full(len(x), texts["chunk"][0].as_py())), pa.array(ids[x]), pa.array(ids[y]), pa.array(count)], schema=schema)


def _longer_rows(max_n: int, texts: pa.Table, known: pa.Table) -> pa.Table:
    """Distinct n-grams of 3 and 4 words whose pairs are all frequent, as ids of their words (the fourth is -1 if there is none), with counts.

    known: the chunk's frequent words (local, x) and pairs (x, y; local is null).
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("u", pa.int64()), ("count", pa.int64())])
    if not texts.num_rows or not known.num_rows:
        return schema.empty_table()
    is_pair = known["local"].is_null().to_numpy()
    pairs = known.filter(pa.array(is_pair))
    if not pairs.num_rows:
        return schema.empty_table()
    words = known.filter(pa.array(~is_pair))
    at, ids = _named(texts, pa.table({"local": words["local"].cast(pa.int32()), "id": words["x"]}))
    key = np.unique(np.searchsorted(ids, pairs["x"].to_numpy()) * len(ids) + np.searchsorted(ids, pairs["y"].to_numpy()))
    own = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * len(ids) + at[1:], -1)
    found = np.minimum(np.searchsorted(key, own), len(key) - 1)
    pair = np.where(key[found] == own, found, -1)
    out = []
    for n in range(3, max_n + 1):
        ok = np.ones(max(0, len(pair) - n + 2), bool)
        for k in range(n - 1):
            ok &= pair[k : k + len(ok)] >= 0
        first = np.flatnonzero(ok)
        one, last, count = _counted(pair[first], pair[first + n - 2], len(key))
        one, last = key[one], key[last]
        if n == 3:
            places = [one // len(ids), one % len(ids), last % len(ids)]
            columns = [ids[p] for p in places] + [np.full(len(one), -1)]
        else:
            columns = [ids[p] for p in (one // len(ids), one % len(ids), last // len(ids), last % len(ids))]
        out.append(pa.table([pa.array(c) for c in columns] + [pa.array(count)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of every phrase of 1 to max_n (4 at most) words with f >= min_count, and (lang, n)."""
    if not 2 <= max_n <= 4:
        raise ValueError("max_n is 2, 3 or 4")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = materialize(own.mapInArrow(_chunked(chunk_bytes, max(OPEN, chunk_bytes)), CHUNKS), "chunks")
    texts = chunks.where("tokens IS NOT NULL").select("chunk", "tokens")
    words = chunks.where("word IS NOT NULL").select("chunk", "lang", "local", "word", "count")
    totals = materialize(words.groupBy("lang").agg(F.sum("count").alias("n")), "totals")

    # A key has a row for each chunk at most: the total goes back to each of them in the same shuffle.
    words = materialize(words.withColumn("f", F.sum("count").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= min_count), "words")
    vocabulary = materialize(words.groupBy("lang", "word").agg(F.first("f").alias("f")).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    words = materialize(words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "local", "id"), "ids")

    pairs = texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_pair_rows, "chunk long, x long, y long, count long")
    pairs = materialize(pairs.withColumn("f", F.sum("count").over(Window.partitionBy("x", "y"))).where(F.col("f") >= min_count), "pairs")
    couples = pairs.groupBy("x", "y").agg(F.first("f").alias("f"))
    word = lambda x, name: vocabulary.select(F.col("id").alias(x), F.col("word").alias(name))
    couples = couples.join(vocabulary.select(F.col("id").alias("x"), "lang", F.col("word").alias("w1")), "x").join(word("y", "w2"), "y")
    grams = [vocabulary.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "f"), couples.select("lang", F.lit(2).alias("size"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "f")]
    if max_n > 2:
        known = words.select("chunk", "local", F.col("id").alias("x"), F.lit(None).cast("long").alias("y")).unionByName(pairs.select("chunk", F.lit(None).cast("int").alias("local"), "x", "y"))
        longer = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(partial(_longer_rows, max_n), "x long, y long, z long, u long, count long")
        longer = materialize(longer.groupBy("x", "y", "z", "u").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count), "longer")
        named = longer.join(vocabulary.select(F.col("id").alias("x"), "lang", F.col("word").alias("w1")), "x").join(word("y", "w2"), "y").join(word("z", "w3"), "z").join(word("u", "w4"), "u", "left")
        grams.append(named.select("lang", F.when(F.col("u") < 0, 3).otherwise(4).alias("size"), F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "f"))
    out = grams[0]
    for g in grams[1:]:
        out = out.unionByName(g)
    return materialize(out, "grams"), totals


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, kept_in: int = KEPT_IN, top: int = TOP, chunk_bytes: int = CHUNK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    score: floor(2000000 * a / (l + r)) at the cut of the phrase in two where it is lowest. A phrase of whose occurrences ``kept_in`` hundredths lie in one longer phrase is left out.
    """
    grams, totals = frequent(docs, text, lang, max_n, min_count, chunk_bytes)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    parts = F.split("phrase", " ")
    several = grams.where("size > 1").withColumnRenamed("f", "a").withColumn("w", parts)
    cuts = several.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"before": F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))), "after": F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")))})
    counts = lambda part, f: grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    scored = cuts.join(counts("before", "l"), ["lang", "before"]).join(counts("after", "r"), ["lang", "after"])
    # div gives the whole quotient of two decimals without a rounded fraction.
    scored = scored.withColumns({"above": F.lit(2_000_000).cast("decimal(10,0)") * exact("a"), "below": exact("l") + exact("r")}).withColumn("score", F.expr("above div below"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # One-word extensions suffice: a phrase inside a longer one is inside one that has a word more, which is at least as frequent.
    inner = grams.where("size > 2").select("lang", "f", F.explode(F.array(F.concat_ws(" ", F.slice(parts, F.lit(1), F.col("size") - 1)), F.concat_ws(" ", F.slice(parts, F.lit(2), F.col("size") - 1)))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = (scored["lang"] == inner["lang"]) & (scored["phrase"] == inner["phrase"]) & (F.lit(100) * inner["longer"].cast("decimal(20,0)") >= F.lit(kept_in) * scored["a"].cast("decimal(20,0)"))
    left = scored.join(inner, held, "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the first 2000 phrases of each language."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3), (4)) t(k))),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 30),
cut AS (SELECT *, array_to_string(list_slice(w, 1, j), ' ') AS before, array_to_string(list_slice(w, j + 1, k), ' ') AS after FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM cand)),
scored AS (SELECT cut.lang, cut.phrase, a, min({'score': (2000000::HUGEINT * a // (x.f + y.f))::BIGINT, 'j': j, 'l': x.f, 'r': y.f}) AS s FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = before JOIN c y ON y.lang = cut.lang AND y.phrase = after GROUP BY ALL),
longer AS (SELECT lang, f, unnest([array_to_string(list_slice(w, i, i + m - 1), ' ') FOR i IN generate_series(1, k - m + 1)]) AS phrase FROM (SELECT lang, a AS f, k, w, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2)),
most AS (SELECT lang, phrase, max(f) AS f FROM longer GROUP BY ALL),
kept AS (SELECT scored.* FROM scored LEFT JOIN most USING (lang, phrase) WHERE most.f IS NULL OR 100::HUGEINT * most.f < 80::HUGEINT * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, encode(phrase)) AS rank, phrase, a, s.l AS l, s.r AS r, s.score AS score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
