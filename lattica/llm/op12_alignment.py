"""Alignment of two tokenizers over one text: which tokens of either stand for the same bytes, and how often a pair does in the corpus.

**Groups.** The byte ranges of the B tokens are a static interval index: their starts in order. For each A token two bisections in it list the B tokens it overlaps. A gap
between two B tokens that no A token spans is where tokens of both end: a border between groups. All tokens of a group are linked with each other.

**Parts.** Neither tokenizer lets a token reach from a visible character over a single space to another one (the pattern of A parts there, and no piece of B has a space behind
another character, which is checked of the model), so texts are cut there and each different part is encoded and aligned once in a chunk. A text with a part that B doesn't give back is encoded whole.

**Counts.** Texts are handled in chunks of bounded size. A chunk has a table of its different linked pairs with the number of its documents that hold each; sums over chunks are the corpus-wide counts, and each
chunk gets back those of its own pairs. So a pair has at most one row for each chunk, however common it is, and the documents' links are never rows. The best count of each A id is a table no longer than A's vocabulary.

Defined results: null and empty texts, and those whose tokens don't give back space + text, have no tokens: zeros and an empty ``groups_sha256``. Every row is a document of its own, also with an equal or null id. A very long text is
encoded whole, in a chunk of its own. All ids that tie for the best count are best. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidied, worker_cache
from .words import ragged

#: Characters of text, and different parts, in a chunk.
CHUNK, PARTS = 8 << 20, 300_000
#: Groups with more links than this are counted by their different ids.
LARGE = 64


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(a_path, "rb"))}
        # The same ids as the tokenizers file beside it gives with special tokens' strings as plain text.
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.divides = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by A and of text by B; None if their bytes differ from space + text."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        own = (" " + text).encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != own or b"".join(map(self.a_bytes.__getitem__, a)) != own:
            return None
        return a, b


def tokenizers(paths: tuple[str, str]) -> Pair:
    cache = worker_cache()
    if ("pair", paths) not in cache:
        cache["pair", paths] = Pair(*paths)
    return cache["pair", paths]


_EDGE = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s|^\s|\s$")


def parts_of(text: str) -> list[str]:
    """The text cut at single spaces between visible characters."""
    return _EDGE.split(text) if _DOUBLE.search(text) else text.split(" ")


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A token and of each B token; both tile the same bytes."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    a_start, b_start = a_end - a_len, b_end - b_len
    first = np.searchsorted(b_start, a_start, "right") - 1
    last = np.searchsorted(b_start, a_end, "left") - 1
    spanned = np.bincount(first, minlength=len(b_len) + 1) - np.bincount(last, minlength=len(b_len) + 1)
    b_group = np.concatenate([[0], np.cumsum(np.cumsum(spanned[: len(b_len) - 1]) == 0)])
    return b_group[first], b_group


class Table:
    """The different parts of a chunk: their numbers of tokens, groups and links, groups as text, and linked pairs with multiplicity."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.at: dict[str, int] = {}
        self.counts: list[np.ndarray] = []
        self.groups: list[str | None] = []  # None: B doesn't give the part back
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, parts: list[str]) -> None:
        """Parts that aren't in the table yet, each once."""
        for lo in range(0, len(parts), 2000):
            some = parts[lo : lo + 2000]
            both = self.pair.encode(" ".join(some)) if self.pair.divides else None
            if both is not None:
                self._append(some, *both)
                continue
            for part in some:  # one by one: some part is not given back
                both = self.pair.encode(part) if part else None
                if both is not None:
                    self._append([part], *both)
                else:
                    self._register([part], np.zeros((1, 4), np.int64), [None if part else ""], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _register(self, parts, counts, groups, keys, times, sizes):
        for p in parts:
            self.at[p] = len(self.at)
        self.counts.append(counts)
        self.groups += groups
        self.keys.append(keys)
        self.times.append(times)
        self.sizes.append(sizes)

    def _append(self, parts, a, b):
        pair, n = self.pair, len(parts)
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        a_len, b_len = pair.a_len[a], pair.b_len[b]
        a_group, b_group = overlaps(a_len, b_len)
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        b_part = np.searchsorted(ends, np.cumsum(b_len) - b_len, "right")
        a_part = np.searchsorted(ends, np.cumsum(a_len) - a_len, "right")
        groups = int(b_group[-1]) + 1
        of = np.empty(groups, np.int64)
        of[b_group] = b_part
        na, nb = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        links = na * nb
        counts = np.stack([np.bincount(a_part, minlength=n), np.bincount(b_part, minlength=n), np.bincount(of, minlength=n), np.bincount(of, weights=links, minlength=n).astype(np.int64)], 1)
        # Text of the groups: a token's id and what parts it from the next one.
        a_first, b_first = np.cumsum(na) - na, np.cumsum(nb) - nb
        a_at = np.arange(len(a)) + b_first[a_group]
        b_at = np.arange(len(b)) + (a_first + na)[b_group]
        text = np.empty(len(a) + len(b), object)
        text[a_at] = [pair.a_text[i] for i in a.tolist()]
        text[b_at] = [pair.b_text[i] for i in b.tolist()]
        sep = np.full(len(text), ",", object)
        sep[(a_first + na + b_first) - 1] = "|"
        close = (a_first + na + b_first + nb) - 1
        sep[close] = ";"
        last = np.flatnonzero(np.diff(of, append=n))
        sep[close[last]] = ""
        whole = (text + sep).tolist()
        stops = (close[last] + 1).tolist()
        strings = ["".join(whole[x:y]) for x, y in zip([0] + stops[:-1], stops)]
        # Linked pairs: of small groups one by one, of large ones by different ids.
        small = links <= LARGE
        rows = np.flatnonzero(small)
        g = np.repeat(rows, links[rows])
        k = ragged(np.zeros(len(rows), np.int64), links[rows])
        keys = [a[a_first[g] + k // nb[g]] << 32 | b[b_first[g] + k % nb[g]]]
        owner, times = [of[g]], [np.ones(len(g), np.int64)]
        for x in np.flatnonzero(~small):
            ia, ca = np.unique(a[a_first[x] : a_first[x] + na[x]], return_counts=True)
            ib, cb = np.unique(b[b_first[x] : b_first[x] + nb[x]], return_counts=True)
            keys.append((ia[:, None] << 32 | ib).ravel())
            times.append((ca[:, None] * cb).ravel())
            owner.append(np.full(len(ia) * len(ib), of[x]))
        keys, times, owner = np.concatenate(keys), np.concatenate(times), np.concatenate(owner)
        order = np.lexsort((keys, owner))
        keys, times, owner = keys[order], times[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self._register(parts, counts, strings, keys[at], np.add.reduceat(times, at), np.bincount(owner[at], minlength=n))


DOCS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *DOCS, ("links", pa.binary()), ("local", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
ROWS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, local int, a int, b int, docs long"


def _packed(*arrays: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of their places, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate(arrays).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunk_rows(chunk: int, ids: list, texts: list[list[int] | None], table: Table):
    """Record batches of a chunk: its documents (texts: numbers of their parts; None: no tokens), then its linked pairs."""
    counts = np.concatenate(table.counts) if table.counts else np.zeros((0, 4), np.int64)
    sizes = np.concatenate(table.sizes) if table.sizes else np.zeros(0, np.int64)
    keys, local = np.unique(np.concatenate(table.keys) if table.keys else np.zeros(0, np.int64), return_inverse=True)
    times = np.concatenate(table.times) if table.times else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    docs = np.zeros(len(keys), np.int64)
    for lo in range(0, len(ids), 256):
        rows = []
        for doc, text in zip(ids[lo : lo + 256], texts[lo : lo + 256]):
            if text is None:
                rows.append((chunk, doc, 0, 0, 0, 0, "", None))
                continue
            part, n = np.unique(np.asarray(text), return_counts=True)
            sums = n @ counts[part]
            flat = ragged(first[part], sizes[part])
            own, place = np.unique(local[flat], return_inverse=True)
            weight = np.bincount(place, weights=times[flat] * np.repeat(n, sizes[part])).astype(np.int64)
            docs[own] += 1
            sha = hashlib.sha256(";".join([table.groups[i] for i in text]).encode()).hexdigest()
            rows.append((chunk, doc, *sums.tolist(), sha, _packed(np.diff(own, prepend=0), weight)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)]
        yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), t) for t in SCHEMA.types[8:]], schema=SCHEMA)
    for lo in range(0, len(keys), 100_000):
        k = keys[lo : lo + 100_000]
        tail = [np.arange(lo, lo + len(k), dtype=np.int32), (k >> 32).astype(np.int32), (k & 0xFFFFFFFF).astype(np.int32), docs[lo : lo + 100_000]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk))] + [pa.nulls(len(k), t) for t in SCHEMA.types[1:8]] + [pa.array(x) for x in tail], schema=SCHEMA)


def _encoded(paths: tuple[str, str], chunk_chars: int, max_parts: int):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        pair = tokenizers(paths)
        table, ids, texts, held, made = Table(pair), [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if ids and (held + len(text or "") > chunk_chars or len(table.at) > max_parts):
                        yield from chunk_rows((part << 32) + made, ids, texts, table)
                        table, ids, texts, held, made = Table(pair), [], [], 0, made + 1
                    ids.append(doc)
                    texts.append(_numbers(table, text))
                    held += len(text or "")
        if ids:
            yield from chunk_rows((part << 32) + made, ids, texts, table)

    return tidied(run)


def _numbers(table: Table, text: str | None) -> np.ndarray | None:
    """Numbers of the text's parts in the table; None if the text has no tokens."""
    if not text:
        return None
    parts = parts_of(text) if table.pair.divides else [text]
    new = [p for p in dict.fromkeys(parts) if p not in table.at]
    if new:
        table.add(new)
    numbers = [table.at[p] for p in parts]
    if any(table.groups[i] is None for i in set(numbers)):
        # Some part alone isn't given back; the whole text decides.
        if text not in table.at:
            both = table.pair.encode(text)
            if both is None:
                return None
            table._append([text], *both)
        if table.groups[table.at[text]] is None:
            return None
        numbers = [table.at[text]]
    return np.asarray(numbers, np.int32)


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the corpus-wide counts of its pairs (local, count, best)."""
    n = counts.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    local = counts["local"].to_numpy()
    count[local], best[local] = counts["count"].to_numpy(), counts["best"].to_numpy()
    sums, bests = [], []
    for links in docs["links"]:
        raw = links.as_py()
        if raw is None:
            sums.append(0)
            bests.append(0)
            continue
        step, weight = np.split(_unpacked(raw).astype(np.int64), 2)
        own = np.cumsum(step)
        sums.append(int(count[own] @ weight))
        bests.append(int(best[own] @ weight))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([docs[c].cast(pa.int64()) for c in names] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"].cast(pa.string())], [*names, "n_best", "count_sum", "groups_sha256"])


def paths_of(a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, chunk_chars: int = CHUNK, max_parts: int = PARTS) -> DataFrame:
    """Chunks: a row for each document, and one for each different linked pair of a chunk (a is not null)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(own.mapInArrow(_encoded(paths or paths_of(), chunk_chars, max_parts), ROWS), "encoded")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, count): the number of documents that hold each linked pair of ids."""
    return chunks.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("count"))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, chunk_chars: int = CHUNK, max_parts: int = PARTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    chunks = encoded(docs, id_col, text, paths, chunk_chars, max_parts)
    counted = chunks.where("a IS NOT NULL").select("chunk", "local", "a", "b", F.sum("docs").over(Window.partitionBy("a", "b")).alias("count"))
    counted = materialize(counted, "counted")
    best = counted.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of A at most
    back = counted.join(F.broadcast(best), "a").select("chunk", "local", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    own = chunks.where("groups_sha256 IS NOT NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_summed, out)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the alignment of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
