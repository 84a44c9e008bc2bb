import hashlib
import random
import re

import numpy as np

from lattica.llm import op11_substrings as s


def brute(rows, window=50):
    """{row number: (n_words, n_removed, sha)}"""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if doc is not None:
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ß x", "　", "Ж"]
    text = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    passage, long_passage = text(60), text(400)
    docs = [text(rng.randrange(0, 300)) for _ in range(25)]
    for k in (3, 7, 8, 12, 20):  # passages at different places
        docs.append(docs[k][:40] + passage + docs[k][30:])
    docs += [docs[5], docs[5], docs[6] + ["x"] + docs[6]]
    near = list(long_passage)
    for at in (49, 120, 200, 251, 330):
        near[at] = "edited"
    docs += [long_passage, near, long_passage[10:300], near[:170] + long_passage[170:]]
    docs += [["a"] * 49, ["a"] * 50, ["a"] * 400, ["a"] * 300 + ["b"] * 300, ["b"] * 60 + ["a"] * 60, ["a", "b"] * 200, ["b", "a"] * 26, ["a", "b", "c"] * 90, ["x"] + ["a", "b", "c"] * 40 + ["y"]]
    docs += [passage[:50], passage[:49], passage[5:55], text(300, ["p", "q"]), text(2000, ["p", "q"]), text(3000, ["p"] * 9 + ["q"])]
    docs.append(docs[-1][100:900])
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(d)) for i, d in enumerate(docs)]
    rows += [(None, " ".join(long_passage)), (900, None), (901, ""), (902, " \t\r\x0b\x0c"), (5, rows[5][1]), (903, " ".join(docs[1] + docs[2])), (903, " ".join(docs[2] + docs[3])), (-4, " ".join(docs[9]))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = cases()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, name int").repartition(3)
    got = sorted(map(tuple, s.without_repeats(frame).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert sum(r[2] for r in got) > 2000
    texts = s.without_repeats(frame, with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in texts)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for alphabet in (2, 5, 1000):
        words = rng.integers(1, alphabet + 1, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words[2000:2300] = words[500:800]
        wall = np.zeros(len(words), bool)
        at = np.arange(len(words) - 49)
        key, place, _ = s.anchors(words, wall, at)
        for i in range(500, 751):
            assert (place[i] < 0) == (place[i + 1500] < 0) and (place[i] < 0 or (key[i], place[i] - i) == (key[i + 1500], place[i + 1500] - i - 1500))
        assert np.all((place < 0) | ((place >= at) & (place < at + 50)))
        own = s.window_hashes(s.doublings(words, 50), 50)
        assert len(set(own.tolist())) == len({words[i : i + 50].tobytes() for i in at})


def test_empty(spark):
    assert s.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
