import random
import re
from collections import Counter

import pytest

from lattica.llm import op13_phrases as p


def brute(rows, max_n=4, least=30, kept_in=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        s, _, l_, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        inside = any(o == lang and len(x) > len(w) and 100 * b >= kept_in * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (o, x), b in cand.items())
        if not inside:
            out.append((lang, -s, -a, " ".join(w).encode(), l_, r))
    ranked, at = [], Counter()
    for lang, s, a, w, l_, r in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], w.decode(), -a, l_, r, n[lang], -s))
    return ranked


def texts():
    rng = random.Random(11)
    vocab = ["New", "york", "city", "the", "of", "a", "é", "Ünder", "x|y", " thin", "hall"]
    fixed = ["new York city hall", "of the", "a of the new", "x|y x|y x|y x|y", "Ünder é"]
    rows = []
    for i in range(120):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!? "]) for x in parts)))
    return rows + [("en", None), ("en", ""), ("fr", " \t\n.,"), ("fr", "one word"), rows[3], rows[3]]


@pytest.mark.parametrize(("max_n", "least", "top", "chunk"), [(4, 5, 2000, 1 << 20), (4, 3, 7, 300), (3, 4, 2000, 2000), (2, 4, 2000, 1 << 20)])
def test_against_brute_force(spark, max_n, least, top, chunk):
    rows = texts()
    frame = spark.createDataFrame([(a, b, 1, "w") for a, b in rows], "lang string, text string, n int, word string").repartition(3)
    got = sorted(map(tuple, p.phrases(frame, max_n=max_n, min_count=least, top=top, chunk_bytes=chunk).collect()))
    want = sorted(brute(rows, max_n, least, top=top))
    assert got == want and len(got) > 10


def test_empty(spark):
    assert p.phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        p.phrases(spark.createDataFrame([], "lang string, text string"), max_n=5)
