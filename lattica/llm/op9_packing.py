"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Texts become token ids and a closing id; only documents longer than a sequence are cut. Pieces are dealt evenly to partitions of
bounded size, and each packs its pieces best-fit, longest first. Nearly full bins are emitted. The others go on as items, as long as what
they hold, to a tree of merges: each round gathers the items of several partitions in one, packs them best-fit and emits what is then nearly full, until one
partition is left or a round no longer merges anything worth it; then the rest is emitted. An item that is merged keeps its pieces together, so
each round writes (bin, into which bin) and the pieces' final places follow from joining those tables.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; rows with a null id are packed
too; an empty table gives an empty table; extra columns are ignored. A very long text is encoded whole. Pieces of equal
length are taken in the order of their place in the table, which reruns may change.
"""

from __future__ import annotations

import base64
import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidied, worker_cache

CAPACITY = 2048
END = 0
#: Items packed in one task, about.
ITEMS = 40_000
#: A bin with no more free tokens than this share of its capacity is nearly full.
NEARLY = 0.004
#: Partitions merged into one in a round.
FAN_IN = 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """A function from texts to lists of ids, loaded once in a worker: those of the tokenizers file, add_special_tokens=False.

    Strings of the file's special tokens in a text become those tokens' ids. If the same vocabulary lies beside the file as ranks (.tiktoken), texts without such strings
    are encoded by those: the same ids, some times faster.
    """
    cache = worker_cache()
    if path not in cache:
        import re
        from pathlib import Path

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        exact = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        ranks = Path(path).with_suffix(".tiktoken")
        if path.endswith(".json") and ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
            cache[path] = lambda texts: [exact([t])[0] if special.search(t) else fast.encode_ordinary(t) for t in texts]
        else:
            cache[path] = exact
    return cache[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; if they don't divide, the first is the short one."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row, and the ids themselves if wanted."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encode = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # few texts' ids at a time
                part = b.slice(at, 64)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(np.asarray(ids, "<u4"), np.uint32(END))
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + n]
                        rows.append((doc, k, start, n, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and what each bin holds; longest items first, each into the fullest bin that takes it."""
    bins = np.empty(len(sizes), np.int64)
    held: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    frees: list[int] = []  # free spaces that have a bin, in order
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        at = bisect.bisect_left(frees, n)
        if at < len(frees):
            free = frees[at]
            b = open_at[free].pop()
            if not open_at[free]:
                frees.pop(at)
        else:
            free, b = capacity, len(held)
            held.append(0)
        bins[i] = b
        held[b] += n
        free -= n
        if free:
            if not open_at[free]:
                bisect.insort(frees, free)
            open_at[free].append(b)
    return bins, np.array(held, np.int64)


PLACED = "item long, size long, bin long, held long"


def _pack(items: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """items (item, size, part) -> (item, size, bin, held): best-fit in each part. Bins have ids of their own in every round."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending")])
        bins, held = best_fit(table["size"].to_numpy(), capacity)
        part = table["part"][0].as_py()
        ids = (np.int64(round_) << 56) | (np.int64(part) << 24) | bins
        return pa.table({"item": table["item"], "size": table["size"], "bin": ids, "held": held[bins]})

    return items.groupBy("part").applyInArrow(run, PLACED)


def pack(sized: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS) -> DataFrame:
    """sized (item long, unique; size long in 1 .. capacity) -> (item, size, sequence_id, offset)."""
    sized = sized.select("item", "size")
    n = sized.count()
    parts = max(1, math.ceil(n / items_per_task))
    deal = lambda df, k, salt: df.withColumn("part", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(k)).cast("long"))
    nearly = capacity - int(capacity * NEARLY)
    moves: list[DataFrame] = []
    items, round_ = sized, 0
    while True:
        placed = materialize(_pack(deal(items, parts, round_), parts, round_, capacity), f"round{round_}")
        moves.append(placed)
        if parts == 1:
            break
        open_ = placed.where(F.col("held") < nearly).groupBy("bin").agg(F.first("held").alias("size"))
        left = open_.agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.sum((2 * F.col("size") <= capacity).cast("long")).alias("half")).first()
        # Bins over half full never share one: merging ends when nothing that could move is left.
        if not left["half"]:
            break
        parts = max(1, min(math.ceil(parts / FAN_IN), math.ceil(left["n"] / items_per_task)))
        items, round_ = open_.select(F.col("bin").alias("item"), "size"), round_ + 1
    # From the last round back: the bin that each round's bin ends in, and where in it.
    final = None
    for placed in reversed(moves):
        before = Window.partitionBy("bin").orderBy(F.col("size").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
        inner = placed.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
        if final is None:
            final = inner.select("item", "size", F.col("bin").alias("sequence_id"), "offset")
        else:
            outer = final.select(F.col("item").alias("bin"), F.col("sequence_id").alias("_root"), F.col("offset").alias("_at"))
            final = inner.join(outer, "bin", "left").select(
                "item", "size", F.coalesce("_root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("_at", F.lit(0))).alias("offset")
            )
    return final


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    cutted = materialize(pieces(docs, id_col, text, capacity, path).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(cutted.select("item", F.col("length").alias("size")), capacity)
    return cutted.join(placed.select("item", "sequence_id", "offset"), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every piece of every document and its place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
