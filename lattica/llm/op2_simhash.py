"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has two 32-bit segments, each with a lookup table. Two fingerprints at distance 2 or less differ by one bit at most in one of the
segments, so one finds the other by the Hamming ball of radius 1 around its own value of that segment. Of two values that differ by one
bit, the one that lacks it looks for the other: a ball then holds the value itself and the values with one bit more, and each pair is met
once. What the tables hold at those values are candidates; the complete distance decides.
A segment value that more than ``CROWDED`` fingerprints share would make all of them candidates of each other. Such values are refined by the
other segment: entries and lookups write the ball of radius 1 around that one too, and meet where both segments agree.
Links are between distinct fingerprints, of which at most 2,080 lie within distance 2 of any one.

:func:`similar_groups` finds near duplicates by similarity instead of by two bits, by tables for the segments of longer fingerprints; see there.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; texts with fewer words than a shingle hash
their whole sequence; a very long text is hashed whole, in blocks; equal texts share a fingerprint; repeated rows each get a row; a row whose doc_id is null gets
a null component and links nothing; an empty table gives an empty table. Extra columns pass through ``dedup`` untouched, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidied
from .components import components

SEED = 42
RADIUS = 2
#: Fingerprints that share a segment's value before it is refined by the other segment.
CROWDED = 512
#: Shingles hashed at a time, so that a very long text takes bounded memory.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: bit k is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z only and splits at the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        h = np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(at, upto)), "<u8", upto - at)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) for each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return slim.mapInArrow(tidied(run), "doc_id long, fp long")


def _one_bit_more(value: Column) -> Column:
    """Of a segment's value in the lower 32 bits: the values of the ball of radius 1 around it that have one bit more."""
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(32)])
    return F.transform(F.filter(bits, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """nodes (fp long, distinct) -> (a, b): all pairs of fingerprints within RADIUS, in one order or both."""
    half = (1 << 32) - 1
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(half))
    segments = F.array(*[F.struct(F.lit(k).cast("long").alias("seg"), v.alias("value"), o.alias("other")) for k, v, o in ((0, lower, upper), (1, upper, lower))])
    table = nodes.select("fp", F.explode(segments).alias("s")).select("fp", F.shiftleft("s.seg", 32).bitwiseOR(F.col("s.value")).alias("key"), F.col("s.other").alias("other"))
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(32)])
    probes = table.select("fp", "other", F.explode(F.concat(F.array("key"), _one_bit_more(F.col("key")))).alias("key"))
    second = lambda df: df.withColumnRenamed("fp", "fp_2")

    def near(met: DataFrame) -> DataFrame:
        return met.where((F.col("fp") != F.col("fp_2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_2"))) <= RADIUS)).select(F.col("fp").alias("a"), F.col("fp_2").alias("b"))

    hot = materialize(table.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    if hot.isEmpty():
        return near(probes.select("key", "fp").join(second(table.select("key", "fp")), "key"))
    plain = near(probes.select("key", "fp").join(second(table.select("key", "fp").join(hot, "key", "left_anti")), "key"))
    ball = F.transform(F.concat(F.array(F.lit(0).cast("long")), bits), lambda m: F.col("other").bitwiseXOR(m))
    # Both sides write their balls: values at distance 2 have a neighbour in common, and at most 33 entries meet at one.
    refined = lambda df: df.join(hot, "key", "left_semi").select("key", "fp", F.explode(ball).alias("finer"))
    return plain.unionByName(near(refined(probes).join(second(refined(table)), ["key", "finer"])).distinct())


def cluster(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    fps = materialize(with_fingerprints(docs, id_col, text, shingle), "fingerprints")
    nodes = materialize(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "component")
    named = materialize(nodes.join(found, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    named = materialize(named.join(least, "component").select("fp", "component_id"), "components")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """docs with one document of each component: the one whose id names it. Of repeated rows of that id one stays.

    Rows with a null id stay, since nothing tells them apart.
    """
    return _keep_first(docs, materialize(cluster(docs, id_col, text, shingle), "clustered"), id_col)


def _keep_first(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """docs without those that found (doc_id, component_id) puts after another, and without repeated rows of an id.

    Only ids that go or repeat are joined to the rows, and only rows of repeated ids are shuffled by id.
    """
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("goes"), F.count("*").alias("n"))
    marks = materialize(ids.where("goes OR n > 1").select(F.struct("doc_id", "goes").alias("_mark")), "marks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    marked = whole.join(marks, F.col("_id") == F.col("_mark.doc_id"), "left")
    kept = marked.where("_mark IS NULL")
    if not marks.where("NOT _mark.goes").isEmpty():
        kept = kept.unionByName(marked.where("NOT _mark.goes").dropDuplicates(["_id"]))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


# --- near duplicates by similarity -----------------------------------------------------------------------------------

#: Documents of the sample that common shingles are counted in, and how many of them a common shingle is in at least.
SAMPLE, COMMON = 20_000, 4
#: 64-bit words of a sketch.
SKETCH = 4
#: Members of a key, members of a candidate group, and shingles of a candidate group's members that are compared in one task at most.
MEMBERS, GROUP, SHINGLES = 2_000, 4_000, 4_000_000
#: Bits of the bitmap of ids.
MARKS = 1 << 23
#: Sets that a worker remembers, so that copies in its partition are looked up once.
SEEN = 500_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The hashes of the text's distinct shingles, sorted; texts with fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(_mix(h).view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH words of SimHash over a set of hashes, each hash once."""
    counts = np.zeros((SKETCH * 8, 8), np.int64)
    at = np.arange(SKETCH * 8, dtype=np.int64) * 256
    for a in range(0, len(s), BLOCK):
        part = s[a : a + BLOCK].view(np.uint64)
        wide = np.stack([_mix(part + np.uint64(k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) for k in range(SKETCH)], 1)
        spots = wide.view(np.uint8).reshape(len(part), -1) + at
        counts += np.bincount(spots.ravel(), minlength=SKETCH * 8 * 256).reshape(-1, 256) @ _BITS
    return np.packbits((2 * counts > len(s)).astype(np.uint8)).view("<i8")


def sketch_limit(similarity: float) -> int:
    """Bits by which sketches of sets of that similarity differ at most: seven standard deviations above the mean, passed once in 10**11 pairs."""
    cosine = 2 * similarity / (1 + similarity)  # the least that sets of any sizes have
    p, n = float(np.arccos(min(1.0, cosine))) / np.pi, 64 * SKETCH
    return int(n * p + 7 * np.sqrt(n * p * (1 - p)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def _common(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that recur in a sample of bounded size, and how often they do."""
    n = slim.count()

    def run(batches):
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), shingle), pa.int64())], ["h"])

    some = slim.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(max(1, n))) < SAMPLE))
    found = some.select("text").mapInArrow(tidied(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toPandas().sort_values("h")
    return found.h.to_numpy(np.int64), found.n.to_numpy(np.int64)


def _ratio(similarity: float) -> tuple[int, int]:
    """A similarity as a ratio of integers, so that no comparison rounds."""
    return Fraction(str(similarity)).as_integer_ratio()


def _prefixes(slim: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, s0, s1: hash of the whole set, n: its size, sketch, prefix) for each row; copies within a partition have no prefix."""
    p, q = _ratio(similarity)
    common = slim.sparkSession.sparkContext.broadcast(_common(slim, shingle))
    names = ["doc_id", "s0", "s1", "n", "sketch", "prefix"]

    def run(batches):
        known, often = common.value
        seen: dict[bytes, np.ndarray] = {}
        for b in batches:
            whole, sizes, sketches, prefix = [], [], [], []
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(x.as_py(), shingle)
                name = xxhash.xxh128_digest(s.tobytes(), SEED)
                whole.append(name)
                sizes.append(len(s))
                if name in seen or doc is None:
                    sketches.append(seen[name] if name in seen else np.zeros(SKETCH, np.int64))
                    prefix.append(s[:0])
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[name] = sketch(s)
                sketches.append(seen[name])
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                prefix.append(s[: len(s) - -(-p * len(s) // q) + 1])
            sums = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            columns = [pa.array(np.ascontiguousarray(sums[:, k]), pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(sizes, pa.int64()), _lists(sketches), _lists(prefix)], names)

    return slim.mapInArrow(tidied(run), "doc_id long, s0 long, s1 long, n long, sketch array<long>, prefix array<long>")


class _Forest:
    """Components of numbers 0 .. n - 1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        up = self.root
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
        while not np.array_equal(up[up], up):
            up[:] = up[up]

    def edges(self, ids: np.ndarray) -> pa.RecordBatch:
        far = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64()), pa.array(ids[self.root[far]], pa.int64())], ["a", "b"])


def _whole_groups(batches, keys: list[str], least: int):
    """Tables of whole groups, at least so many rows if there are, from batches in which each group's rows are neighbours."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(t.num_rows, bool)
        for k in keys:
            c = t[k].to_numpy()
            same &= c == c[-1]
        end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if end:
            yield t.slice(0, end)
        held, rows = t.slice(end).combine_chunks().to_batches(), t.num_rows - end
    if rows:
        yield pa.Table.from_batches(held)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group starts, and the end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _blocks(df: DataFrame, sizes: DataFrame, key: str, blocks: str, node: str) -> DataFrame:
    """df with (i, j): rows of a key whose size asks for several blocks are dealt to them, and each pair of blocks is a group."""
    df = df.join(sizes, key, "left").withColumn("_k", F.coalesce(F.col(blocks), F.lit(1)).cast("int"))
    df = df.withColumn("_b", F.pmod(F.xxhash64(node, F.lit(5)), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return df.withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_k", "_b", "_o", blocks)


def _candidates(members: DataFrame, similarity: float) -> DataFrame:
    """members (key, node, known, n, sketch) -> (a, b): a forest over the nodes of different known components that meet at a key, by sizes and sketches that the similarity allows."""
    p, q = _ratio(similarity)
    limit = sketch_limit(similarity)
    keys = ["key", "i", "j"]
    hot = members.groupBy("key").count().where(F.col("count") > MEMBERS).select("key", F.ceil(F.col("count") / MEMBERS).alias("blocks"))
    dealt = _blocks(members, hot, "key", "blocks", "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        for t in _whole_groups(batches, keys, 1 << 15):
            ids, place = np.unique(t["node"].to_numpy(), return_inverse=True)
            n, known, words = t["n"].to_numpy(), t["known"].to_numpy(), _words(t["sketch"])
            starts = _starts(t, keys)
            left = np.repeat(starts[1:], np.diff(starts)) - np.arange(t.num_rows)
            forest = _Forest(len(ids))
            first = np.flatnonzero(left > 1)
            step = 1
            while len(first):  # every row with the row so many places on, in its group
                for at in range(0, len(first), 1 << 16):
                    a = first[at : at + (1 << 16)]
                    b = a + step
                    fits = (known[a] != known[b]) & (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p)
                    fits &= np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) <= limit
                    forest.link(place[a[fits]], place[b[fits]])
                step += 1
                first = first[left[first] > step]
            yield forest.edges(ids)

    return dealt.select(*keys, "node", "known", "n", "sketch").mapInArrow(tidied(run), "a long, b long")


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *[c.flatten().to_numpy().view(np.uint64) for c in column.chunks]]).reshape(len(column), -1)


def _sets(slim: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) for each row that nodes (node) name, and by chance some more: their ids are marked in a bitmap of bounded size, so texts aren't shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    ids = nodes.select(place("node").alias("at"))
    words = ids.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    shared = slim.sparkSession.sparkContext.broadcast(np.unpackbits(marks.view(np.uint8), bitorder="little").view(bool))

    def run(batches):
        marked, seen = shared.value, set()
        for b in batches:
            b = b.filter(pa.array(marked[b.column(2).to_numpy()]))
            for at in range(0, len(b), 64):
                ids_, sets = [], []
                for doc, x in zip(b.column(0).slice(at, 64).to_pylist(), b.column(1).slice(at, 64)):
                    s = shingles(x.as_py(), shingle)
                    name = (doc, xxhash.xxh128_intdigest(s.tobytes()))
                    if name in seen:  # a repeated row
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    ids_.append(doc)
                    sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), _lists(sets)], ["node", "shingles"])

    return slim.where("doc_id IS NOT NULL").withColumn("at", place("doc_id")).mapInArrow(tidied(run), "node long, shingles array<long>")


def _verified(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """sets (node, shingles), groups (node, component) -> (a, b): a forest over all pairs in a group whose sets are that similar."""
    p, q = _ratio(similarity)
    keys = ["component", "i", "j"]
    named = sets.join(groups, "node")
    size = named.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("s"))
    size = size.select("component", F.ceil(F.greatest(F.col("n") / GROUP, F.col("s") / SHINGLES)).alias("blocks")).where("blocks > 1")
    dealt = _blocks(named, size, "component", "blocks", "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def solve(ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray):
        unique, place = np.unique(ids, return_inverse=True)
        forest = _Forest(len(unique))
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
        begins = np.append(np.flatnonzero(new), len(ranked))  # of each shingle's owners
        column = np.empty(len(flat), np.int64)
        column[order] = np.cumsum(new) - 1
        owners = owner[order]
        for k in range(len(n)):
            c = column[offsets[k] : offsets[k + 1]]
            c = c[begins[c + 1] - begins[c] > 1]
            lengths = begins[c + 1] - begins[c]
            jumps = np.repeat(begins[c] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            common = np.bincount(owners[jumps], minlength=len(n))
            near = common * (p + q) >= (n + n[k]) * p
            near[n == 0] = n[k] == 0
            near[k] = False
            b = np.flatnonzero(near)
            forest.link(np.full(len(b), place[k]), place[b])
        return forest.edges(unique)

    def run(batches):
        for t in _whole_groups(batches, keys, 1 << 12):
            starts = _starts(t, keys)
            for a, b in zip(starts[:-1], starts[1:]):
                part = t.slice(a, b - a).combine_chunks()
                lists = part["shingles"].chunk(0)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                yield solve(part["node"].to_numpy(), offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]])

    return dealt.select(*keys, "node", "shingles").mapInArrow(tidied(run), "a long, b long")


def _lookups(nodes: DataFrame) -> DataFrame:
    """nodes (s0, sketch) -> (s0, key): entries and lookups that meet in the tables of the sketches' 32-bit segments.

    Each segment has a table. Sketches that differ by one bit at most in a segment meet at the value of the one that has the bit, so
    all within 4 * SKETCH - 1 bits meet (of 2 * SKETCH segments one differs by one bit at most), and of those farther apart many.
    """
    half = (1 << 32) - 1
    place = lambda k, upper: F.shiftleft((2 * k + upper).cast("long"), 32)
    segments = F.flatten(F.transform("sketch", lambda w, k: F.array(place(k, 0).bitwiseOR(w.bitwiseAND(F.lit(half))), place(k, 1).bitwiseOR(F.shiftrightunsigned(w, 32)))))
    table = materialize(nodes.select("s0", F.explode(segments).alias("key")), "segments")
    probes = table.select("s0", F.explode(_one_bit_more(F.col("key"))).alias("key"))
    hits = materialize(probes.join(table.select("key"), "key", "left_semi").select("s0", "key"), "hits")
    several = table.groupBy("key").agg(F.min("s0").alias("lo"), F.max("s0").alias("hi")).where("lo < hi").select("key")
    return table.join(hits.select("key").unionByName(several).distinct(), "key", "left_semi").select("s0", "key").unionByName(hits)


def _checked(slim: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """members (key, node, known, n, sketch) -> (a, b): links between those that meet, by the complete distance of sketches and then by whole sets."""
    groups = materialize(components(_candidates(materialize(members, "members"), similarity)), "groups")
    return materialize(_verified(materialize(_sets(slim, groups, shingle), "sets"), groups, similarity), "verified")


def _by_sketches(slim: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that the tables of the sketches' segments find."""
    members = _lookups(nodes).join(nodes, "s0").select("key", "node", F.col("node").alias("known"), "n", "sketch")
    return _checked(slim, members, shingle, similarity)


def _by_prefixes(slim: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the links that lack between components of nodes (s0, node, known, n, sketch); rows (s0, prefix)."""
    table = rows.select("s0", F.explode("prefix").alias("key"))
    shared = materialize(table.groupBy("key").agg(F.min("s0").alias("lo"), F.max("s0").alias("hi")).where("lo < hi").select("key"), "keys")
    members = materialize(table.join(shared, "key").distinct().join(nodes, "s0").select("key", "node", "known", "n", "sketch"), "met")
    parted = members.groupBy("key").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select("key")
    return _checked(slim, members.join(parted, "key", "left_semi"), shingle, similarity)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row: the components of all pairs whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    By SimHash first: the 256-bit sketch of a set has eight 32-bit segments, each with a lookup table; sketches find each other by balls of radius 1 in a
    segment. The complete distance of what meets is verified, by a limit that a pair of that similarity passes but once in 10**11, and then, within the groups that
    these links make, the whole sets. Texts of 0.8 differ by 39 bits on average and the tables are sure of 15, so they leave some out.

    For those there is an exact way: with all shingles in one order, sets that similar share one of the first n - ceil(0.8 n) + 1 shingles of
    each. Any order gives the same result; shingles that are common in a sample come last, so that passages that many texts share are hardly ever keys.
    Only keys at which components of the first step meet count, only pairs of different ones are compared, and they are verified in the same two ways.

    A key or group too large for one task is dealt to blocks, and each pair of blocks is compared in a task
    of its own; tasks write forests, not pairs. Work on a group of unequal copies grows with the square of its members, which no exact comparison of
    texts that are near but not near enough avoids; shuffles grow with members times blocks.

    Defined results: equal sets are one group (texts without words, too); rows of one id with different texts are one document; a null id has a null component; a very
    long text counts whole; an empty table gives an empty table.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(_prefixes(slim, shingle, similarity), "prefixes")
    known = rows.where("doc_id IS NOT NULL")
    nodes = materialize(known.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), F.max(F.struct("n", "sketch")).alias("x")).select("s0", "s1", "node", "x.n", "x.sketch"), "nodes")
    twice = known.groupBy("doc_id").agg(F.min("s0").alias("lo"), F.max("s0").alias("hi")).where("lo < hi").select("doc_id")
    same = known.select("doc_id", "s0", "s1").join(twice, "doc_id").join(nodes, ["s0", "s1"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = materialize(same.unionByName(_by_sketches(slim, nodes, shingle, similarity)), "linked")
    met = nodes.join(components(links), "node", "left").select("s0", "node", F.coalesce("component", "node").alias("known"), "n", "sketch")
    rest = _by_prefixes(slim, known, materialize(met, "known"), shingle, similarity)
    found = components(links.unionByName(rest))
    named = nodes.select("s0", "s1", "node").join(found, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("component_id"))
    named = materialize(named, "named")
    return rows.select("doc_id", "s0", "s1").join(named, ["s0", "s1"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of :func:`similar_groups`, as :func:`dedup` keeps it."""
    return _keep_first(docs, materialize(similar_groups(docs, id_col, text, shingle, similarity), "similar"), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = cluster(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
