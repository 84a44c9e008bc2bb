"""Removal of repeated word runs by recompression: equal runs of words get equal symbols inside, so shared symbols lead to every repeat.

**Names.** The words of a text are its first symbols. A round names each maximal run of one symbol, then each pair of neighbours of which a bit of the first one's name
says left and of the second one's says right. A name is a 64-bit hash of what it stands for, so all tasks agree on it without a dictionary of names that would grow with the corpus.
What stands inside a run of words far enough from its ends is parsed alike wherever the run occurs: in each round, only the outermost symbol of either end may combine with something outside.

**Anchors.** For each window of ``window`` words, what is sure to be parsed alike is followed from round to round, as long as a few symbols are left; of the last round's
symbols the one with the least name is the window's anchor. It depends on the window's words alone, so equal windows have equal anchors. Consecutive windows with one
anchor make a segment: a row (name, hash of the segment's words, document, place), one for about 16 windows.

**Matches.** Names that two documents share are kept. Segments with equal words under a shared name prove each other: all their windows repeat, whatever the number of copies, and
the smallest document of each kind of segment stands for all of it. Where a name has several kinds of segments (the texts part within them), those that stand for a kind are compared: equal windows have equal words on one side of their anchor at least, over half a window, and where
another document has those too, windows are compared one by one.
A window thus repeats if 128 bits of hashes agree, taken over exactly its words.

No pairs of documents are made: every join is of rows with the distinct names, segments or windows, pre-aggregated before the shuffle, and Spark can split its hot keys.

Defined results: null and empty texts have no words and keep nothing (``kept_sha256`` of the empty string). Rows with one doc_id are one document each, but equal ids never count as smaller, so
they don't remove from each other; equal rows get equal results. A null id is smaller than none and has none smaller: its text is kept whole. Very long texts are taken whole; one text is handled by one task at a time. Ties between
equal least names go to the first. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidied
from .words import Words, pieces_of, ragged

WINDOW = 50
#: Rounds of naming; a symbol then stands for four words on average. More rounds make larger symbols but leave less of a window that is sure to be parsed alike.
ROUNDS = 5
#: A window whose sure part would have fewer symbols after a round (one, after the first) is not followed further.
CHOICE = 3

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def mix(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of the ordered pair (a, b)."""
    x = (a ^ (a >> np.uint64(32))) * _K[0]
    x += b
    x ^= x >> np.uint64(29)
    x *= _K[1]
    x ^= x >> np.uint64(32)
    return x


def doublings(words: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, .. words from each place on, up to ``window`` words."""
    out = [words]
    while (span := 1 << len(out) - 1) * 2 <= window:
        out.append(mix(out[-1][:-span], out[-1][span:]) if len(out[-1]) > span else np.zeros(0, np.uint64))
    return out


def span_hashes(powers: list[np.ndarray], at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the ``length`` words from ``at`` on, from the two largest powers that cover them."""
    out = np.zeros(len(at), np.uint64)
    level = np.frexp(length)[1] - 1
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        out[own] = mix(powers[k][at[own]], powers[k][at[own] + length[own] - (1 << int(k))])
    return out


def window_hashes(powers: list[np.ndarray], window: int) -> np.ndarray:
    """For each place the hash of the ``window`` words from there on; only the places whose window ends inside."""
    n = max(0, len(powers[0]) - window + 1)
    out, at = powers[0][:n] ^ _K[2], 0
    for k, power in enumerate(powers):
        if window >> k & 1:
            out = mix(out, power[at : at + n])
            at += 1 << k
    return out


def _runs(names, starts, wall, words, first: bool):
    """Names maximal runs. Returns the new symbols and, for each old boundary, where a window's sure part then begins (left) or ends (right)."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | wall[1:] | wall[:-1]
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    length = np.diff(at, append=len(names))
    # A run at the end of the sure part may go on outside it; not so if the neighbouring words, which the window holds, differ.
    left, right = np.empty(len(names) + 1, np.int64), np.empty(len(names) + 1, np.int64)
    left[:-1], left[-1], right[0] = run, len(at), 0
    right[1:] = run
    if first:
        left[:-1] += 1
    else:
        last_word = words[np.append(starts[1:], len(words) - 1) - 1]
        left[:-1] += words[starts - 1] == last_word
        right[1:] += words[np.append(starts[1:], len(words) - 1)] != words[starts]
    named = names[at]
    many = length > 1
    named[many] = mix(named[many], length[many].astype(np.uint64))
    return named, starts[at], wall[at], left, right


def _pairs(names, starts, wall, round_: int):
    """Names pairs (a left one, a right one); returns as _runs does."""
    bit = (mix(names, np.uint64(round_)) >> np.uint64(63)).astype(bool)
    l_, r_ = ~bit & ~wall, bit & ~wall
    pair = np.zeros(len(names), bool)
    pair[:-1] = l_[:-1] & r_[1:]
    new = np.ones(len(names), bool)
    new[1:] = ~pair[:-1]
    before = np.zeros(len(names) + 1, np.int64)
    np.cumsum(new, out=before[1:])
    edge = np.arange(len(names) + 1)
    left, right = edge.copy(), edge.copy()
    left[:-1] += r_
    right[1:] -= l_
    named = names.copy()
    at = np.flatnonzero(pair)
    named[at] = mix(names[at], names[at + 1])
    return named[new], starts[new], wall[new], before[left], before[right]


def anchors(words: np.ndarray, wall: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, place, words) of the anchor of each window that begins at a place of ``at``; place -1: a window of so few different words that nothing is left, named as a whole by the caller.

    words: hashes; wall marks places between texts, which nothing crosses.
    """
    names, starts = words, np.arange(len(words))
    key, place, size = np.zeros(len(at), np.uint64), np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
    alive, left, right = np.arange(len(at)), at.copy(), at + window
    round_ = 0
    while len(alive):
        n1, s1, w1, l1, r1 = _runs(names, starts, wall, words, round_ == 0)
        n2, s2, w2, l2, r2 = _pairs(n1, s1, w1, round_)
        next_left, next_right = l2[l1][left], r2[r1][right]
        stays = (next_right - next_left >= (CHOICE if round_ else 1)) & (round_ < ROUNDS)
        if round_:
            done = np.flatnonzero(~stays)
            lo, hi, best = left[done], right[done], left[done].copy()
            least = names[lo]
            for k in range(1, int((hi - lo).max(initial=0))):
                more = lo + k < hi
                x = names[np.where(more, lo + k, lo)]
                better = more & (x < least)
                least, best = np.where(better, x, least), np.where(better, lo + k, best)
            key[alive[done]], place[alive[done]] = least, starts[best]
            size[alive[done]] = np.append(starts, len(words))[best + 1] - starts[best]
        alive, left, right = alive[stays], next_left[stays], next_right[stays]
        names, starts, wall = n2, s2, w2
        round_ += 1
    return key, place, size


def _hashed(words: Words) -> np.ndarray:
    import xxhash

    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))
    return codes[words.ids]


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Of some texts: (text, first word, windows, name, hash of the words, hash of the left half, of the right half) of each segment, as arrays.

    The halves are the anchor with half of what a window holds besides it to the left or right; a half that the text doesn't hold is 0. Two equal windows share their anchor and one of its halves at least.
    """
    words = Words(data, offsets)
    lengths = np.diff(words.first)
    # A wall after each text.
    spread = np.arange(len(words.ids)) + np.repeat(np.arange(len(lengths)), lengths)
    codes = np.zeros(len(words.ids) + len(lengths), np.uint64)
    wall = np.ones(len(codes), bool)
    codes[spread], wall[spread] = _hashed(words), False
    count = np.maximum(lengths - window + 1, 0)
    begin = words.first[:-1] + np.arange(len(lengths))
    at = ragged(begin, count)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    text = np.repeat(np.arange(len(lengths)), count)
    key, place, size = anchors(codes, wall, at, window)
    powers = doublings(codes, window)
    own = window_hashes(powers, window)[at]
    whole = place < 0
    key[whole] = mix(own[whole], _K[2])
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    n, text, place, size = last - first + 1, text[first], place[first], size[first]
    name, seg = key[first], mix(mix(own[first], own[last]), (last - first + 1).astype(np.uint64))
    reach = (window - size + 1) // 2
    halves = []
    for lo in (place - reach, place):
        ok = (place >= 0) & (lo >= begin[text]) & (lo + size + reach <= begin[text] + lengths[text])
        half = np.zeros(len(first), np.int32)
        half[ok] = (span_hashes(powers, lo[ok], (size + reach)[ok]) >> np.uint64(33)).astype(np.int32) | 1
        half[place < 0] = 1
        halves.append(half)
    return text, at[first] - begin[text], n, name.view(np.int64), seg.view(np.int64), *halves


def _parse(window: int):
    def run(batches):
        for b in batches:
            for part, data, offsets in pieces_of(b, 2):
                text, at, n, name, seg, left, right = segments(data, offsets, window)
                of = pa.array(text)
                columns = [pa.array(name), pa.array(seg), part.column(0).take(of), part.column(1).take(of), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(left), pa.array(right)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "seg", "doc", "tag", "at", "n", "left", "right"])

    return tidied(run)


def _compare(window: int):
    """(doc, tag, text, spans: [(at, n, name)]) -> a row for each window in the spans."""

    def run(batches):
        for b in batches:
            for part, data, offsets in pieces_of(b, 2):
                words = Words(data, offsets)
                codes = _hashed(words)
                own = window_hashes(doublings(codes, window), window)
                spans = part.column(3)
                flat, of = spans.flatten(), np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
                at, n, name = (flat.field(k).to_numpy() for k in range(3))
                rows = np.repeat(np.arange(len(at)), n)
                place = ragged(at.astype(np.int64), n.astype(np.int64))
                for lo in range(0, len(rows), 200_000):
                    r, p = rows[lo : lo + 200_000], place[lo : lo + 200_000]
                    doc = pa.array(of[r])
                    columns = [pa.array(name[r]), pa.array(own[words.first[of[r]] + p].view(np.int64)), part.column(0).take(doc), part.column(1).take(doc), pa.array(p.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "win", "doc", "tag", "at"])

    return tidied(run)


def _cut(window: int, with_text: bool):
    """(doc, text, spans: [(at, n)] or null) -> what is left without the words that the spans' windows cover."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for b in batches:
            for part, data, offsets in pieces_of(b, 1):
                out = []
                for doc, k, spans in zip(part.column(0).to_pylist(), range(part.num_rows), part.column(2).to_pylist()):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    n = len(words)
                    if spans:
                        change = np.zeros(n + 1, np.int32)
                        for s in spans:
                            change[s["at"]] += 1
                            change[s["at"] + s["n"] + window - 1] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    kept = b" ".join(words)
                    out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return tidied(run)


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, tag, at, n): windows of a document, n of them from word ``at`` on, that also stand in a document with a smaller id. tag: hash of the text, which tells rows with one id apart."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    segs = materialize(own.mapInArrow(_parse(window), "name long, seg long, doc long, tag long, at int, n int, left int, right int"), "segments")
    shared = segs.groupBy("name").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("name")
    shared = materialize(shared, "shared")
    segs = materialize(segs.join(shared, "name"), "segments")
    kinds = materialize(segs.groupBy("name", "seg").agg(F.min("doc").alias("lo")), "kinds")
    several = kinds.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name", F.lit(True).alias("open"))
    kinds = materialize(kinds.join(several, "name", "left"), "kinds")
    judged = materialize(segs.join(kinds, ["name", "seg"]), "judged")
    whole = judged.where("doc > lo").select("doc", "tag", "at", "n")
    # Windows one by one, of the smallest document of each kind, where another document has the same words on one side of the anchor at least.
    first = materialize(judged.where("doc = lo AND open").select("name", "doc", "tag", "at", "n", "left", "right"), "first")
    sides = first.select("name", "doc", "tag", "at", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("half")), F.struct(F.lit(1).alias("side"), F.col("right").alias("half")))).alias("h"))
    sides = sides.select("name", "doc", "tag", "at", "n", "h.*").where("half <> 0")
    met = materialize(sides.groupBy("name", "side", "half").agg(F.min("doc").alias("l"), F.max("doc").alias("h")).where("l < h").drop("l", "h"), "met")
    first = sides.join(met, ["name", "side", "half"]).select("name", "doc", "tag", "at", "n").distinct()
    spans = first.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n", "name")).alias("spans"))
    windows = own.join(spans, ["doc", "tag"]).select("doc", "tag", "text", "spans").mapInArrow(_compare(window), "name long, win long, doc long, tag long, at int")
    windows = materialize(windows, "windows")
    least = materialize(windows.groupBy("name", "win").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi"), "least")
    found = windows.join(least, ["name", "win"]).where("doc > lo").select("doc", "tag", "at", F.lit(1).alias("n"))
    return whole.unionByName(found)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row."""
    spans = repeats(docs, id_col, text, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))
    cut = own.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans")
    return cut.mapInArrow(_cut(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: what is left of every document without the 50-word windows that a document with a smaller id also has."""
    return materialize(without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY p), ' ') AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
