import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import op12_alignment as x


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b if b in shown else 256 + [c for c in range(256) if c not in shown].index(b)): b for b in range(256)}


def brute(rows, plain):
    t, sp = plain
    level = byte_level()
    held, count = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ab = [bytes(level[c] for c in t.id_to_token(i)) for i in a]
            bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                i = j = p = q = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if p <= q and i < len(a):
                        ga.append(a[i])
                        p += len(ab[i])
                        i += 1
                    else:
                        gb.append(b[j])
                        q += len(bb[j])
                        j += 1
                    if p == q and ga and gb:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = Counter((m, n) for ga, gb in groups for m in ga for n in gb)
        count.update(links.keys())
        held.append((doc, groups, links))
    best = Counter()
    for (m, _), c in count.items():
        best[m] = max(best[m], c)
    out = []
    for doc, groups, links in held:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sum(k for p, k in links.items() if count[p] == best[p[0]]),
                    sum(k * count[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def texts(spark, sf_dir):
    rng = random.Random(2)
    odd = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\ta", "x" * 3000, "é" * 50, "日本語 テキスト", "🙂 🙂🙂 a🙂b", "▁ a", "a▁b c", "<s> </s> <unk> <|endoftext|> x", "<0x0A> a", "don't we'll I'm 's", "a b 　c", "a\x1cb \x1c c", "ﬁ ① ²", "é é",
           "1234567890 12 3.14", "!!!???,,,", "http://a.b/c?d=e&f", "\r\n\r\n", "a\x00b", "​ a ‍", "ababab " * 40, "ß" * 700 + " " + "ab" * 700, "﻿a b"]
    pool = "ab éß日🙂 \n\t.,'0▁ｆ"
    odd += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    whole = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(odd + whole)] + [(3, None), (None, "null id"), (7, "a  b"), (7, "a  b")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, sf_dir, plain):
    rows = texts(spark, sf_dir)
    want = sorted(brute(rows, plain), key=str)
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, chunk int, links string").repartition(3)
    for chunk, parts in ((x.CHUNK, x.PARTS), (500, 20)):
        got = sorted(map(tuple, x.align(frame, chunk_chars=chunk, max_parts=parts).collect()), key=str)
        assert got == want
    assert sum(r[1] == 0 for r in want) > 5 and sum(r[3] > 3 for r in want) > 50


def test_empty(spark):
    assert x.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
