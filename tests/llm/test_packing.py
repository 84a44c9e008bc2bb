import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import op9_packing as p


def slow_ids():
    t = Tokenizer.from_file(p.tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [0]


def check(got, docs, ids_of):
    """Every id of every document is placed once, and no sequence overflows or has gaps."""
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in docs:
        ids = np.array(ids_of(text), "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and (len(ids) > 2048 or len(own) == 1)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins), sum(r.length for r in got)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, tokens = check(p.query(spark, sf_dir).collect(), docs, slow_ids())
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_special_strings_become_their_ids():
    plain = Tokenizer.from_file(p.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endof", ""]
    assert [list(ids) for ids in p.encoder(p.tokenizer_path())(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids


def brute_best_fit(sizes, capacity):
    """Longest first, each into the fullest bin that takes it; a new bin if none does."""
    held, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(held)) if held[b] + sizes[i] <= capacity]
        if fits:
            bins[i] = max(fits, key=lambda b: held[b])
        else:
            bins[i] = len(held)
            held.append(0)
        held[bins[i]] += sizes[i]
    return bins, held


def test_best_fit_matches_brute_force():
    rng = random.Random(8)
    for n in (0, 1, 7, 300):
        sizes = np.array([rng.choice([rng.randrange(1, 65), 33, 64]) for _ in range(n)], np.int64)
        bins, held = p.best_fit(sizes, 64)
        want, want_held = brute_best_fit(sizes.tolist(), 64)
        assert sorted(held.tolist()) == sorted(want_held)
        assert held.tolist() == [sum(sizes[bins == b]) for b in range(len(held))]


def test_fast_ids_are_the_tokenizers(spark):
    rng = random.Random(6)
    fast, slow = p.encoder(p.tokenizer_path()), slow_ids()
    for _ in range(2000):
        t = "".join(chr(rng.choice([rng.randrange(9, 14), rng.randrange(32, 127), rng.randrange(160, 0x400), rng.randrange(0x2000, 0x2100), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(30))) + rng.choice(["", "<|endoftext|>", "  \n "])
        assert list(fast([t])[0]) + [0] == slow(t)


@pytest.mark.parametrize("items_per_task", [50, 400, 10**6])
def test_tree_of_merges(spark, items_per_task):
    rng = random.Random(7)
    sizes = [rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), 1025]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    got = p.pack(df, items_per_task=items_per_task).collect()
    assert sorted(r.item for r in got) == list(range(1500)) and all(sizes[r.item] == r.size for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.size))
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] for b in bins.values())
    assert len(bins) <= len(set(p.best_fit(np.array(sizes), 2048)[0])) * 1.1


def test_hard_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "w " * 5000, 3), (4, "a", 4), (4, "a", 4), (5, "x" * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = p.pack_documents(docs).collect()
    assert len([r for r in got if r.doc_id == 4]) == 2 and len({r.doc_id for r in got}) == 5
    renamed = [r.asDict() for r in got]
    next(r for r in renamed if r["doc_id"] == 4)["doc_id"] = 40  # the repeated row, told apart
    check([Row(**r) for r in renamed], [(d, x) for d, x, _ in rows[:-2]] + [(40, "a"), rows[-1][:2]], slow_ids())
    assert p.pack_documents(docs.limit(0)).count() == 0
    assert p.pieces(docs.where(F.col("doc_id") == 3), with_ids=True).first().ids == slow_ids()("w " * 5000)[: p.cut(len(slow_ids()("w " * 5000)), 2048)[0][1]]
