import random
from collections import Counter

import numpy as np
import xxhash

from lattica.llm import op2_simhash as s
from lattica.llm.components import components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "ONE two", "É É é  x y z", "a b c " * 30_000] + [" ".join(rng.choices(["Ab", "c", "é", "dd"], k=rng.randrange(40))) for _ in range(50)]
    for t in texts:
        assert s.fingerprint(t) == brute_fingerprint(t)


def test_query_matches_brute_force(spark, sf_dir):
    got = s.query(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    fp = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {i: int(f, 16) for i, f in zip(got.doc_id, got.fingerprint)} == fp and got.fingerprint.str.len().eq(16).all()
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(sorted(fp), [fp[i] for i in sorted(fp)])


def test_links_reach_all_at_two_bits(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 2, 3, 4) for _ in range(6)}
    nodes = list(enumerate(sorted(fps)))
    # One segment shared by many, so that values are crowded, and the other near within it.
    fps |= {(7 << 32) | int(x) for x in rng.integers(0, 2**12, 300)} | {(int(x) << 32) | 9 for x in rng.integers(0, 2**32, 200, dtype=np.uint64)}
    nodes = list(enumerate(sorted(fps)))
    signed = [np.uint64(f).astype(np.int64).item() for _, f in nodes]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for crowded in (512, 20):
        assert {frozenset((r.a, r.b)) for r in s.links(df, crowded).collect()} == pairs


def test_hard_rows(spark):
    rows = [(5, "same text here now", 1), (3, "same text here now", 2), (3, "same text here now", 2), (7, None, 3), (8, "", 4), (None, "same text here now", 5), (None, None, 6), (9, "something else entirely different", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in s.cluster(docs).collect() if r.doc_id is not None)
    assert got == [(3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 9)]
    kept = s.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7, 9]
    assert s.cluster(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300), (1, 2), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}, 1: 1, 2: 1}


def test_similar_groups_find_near_copies_and_leave_others(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    originals = [rng.choices(vocabulary, k=rng.randrange(60, 400)) for _ in range(60)]
    texts, of = [], []
    for k, words in enumerate(originals):
        texts.append(words)
        of.append(k)
        for _ in range(3):  # about one word in sixty changed: a similarity of 0.85 or so
            texts.append([rng.choice(vocabulary) if rng.random() < 1 / 60 else w for w in words])
            of.append(k)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t), i) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in s.similar_groups(docs).collect()}
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 100 and sum(got[i] == got[j] for i, j in alike) >= 0.97 * len(alike)
    assert all(of[i] == of[c] for i, c in got.items())
    assert s.dedup_similar(docs).columns == docs.columns


def test_similar_groups_on_hard_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000)) + " "
    rows = [(4, None, 1), (2, "", 2), (9, "one", 3), (8, "ONE", 3), (8, "ONE", 3), (None, "one", 4), (6, long, 5), (7, long + "more", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in s.similar_groups(docs).collect() if r.doc_id is not None)
    assert got == [(2, 2), (4, 2), (6, 6), (7, 6), (8, 8), (8, 8), (9, 8)]
    assert sorted(r.doc_id for r in s.dedup_similar(docs).collect() if r.doc_id is not None) == [2, 6, 8]
    assert s.similar_groups(docs.limit(0)).count() == 0


def exact_groups(texts):
    """text's place -> smallest place of its component of pairs at a five-word Jaccard similarity of 0.8 or more; the similarities."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    often = Counter(x for s in sets for x in s)
    column = {x: k for k, x in enumerate(x for x, n in often.items() if n > 1)}
    x = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        x[i, [column[w] for w in s if w in column]] = 1
    common, n = x @ x.T, np.array([len(s) for s in sets], np.float32)
    np.fill_diagonal(common, n)
    union = n[:, None] + n - common
    near, label = 5 * common >= 4 * union, np.arange(len(sets))
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            return dict(enumerate(label.tolist())), common / union
        label = least


def edited(rng, words, rate):
    return [f"new{rng.randrange(10**9)}" if rng.random() < rate else w for w in words]


def family(rng, copies, rates, length=120):
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    return [edited(rng, base, rng.choice(rates)) for _ in range(copies)]


def grouped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in s.similar_groups(docs).collect()}


def test_similar_groups_of_families_whose_members_are_far_from_the_smallest(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(3):  # copies far from each other, each with a twin
        for words in family(rng, 200, [0.06]):
            texts += [" ".join(words), " ".join(edited(rng, words, 0.01))]
    rng.shuffle(texts)
    want, alike = exact_groups(texts)
    assert (np.triu(alike, 1) >= 0.8).sum() > 400 and len(set(want.values())) > 500
    assert grouped(spark, texts) == want


def test_similar_groups_of_a_family_of_thousands_of_unequal_copies(spark):
    rng = random.Random(22)
    texts = [" ".join(w) for w in family(rng, 2500, [0.001, 0.01, 0.02, 0.03, 0.04], 80)]
    want, _ = exact_groups(texts)
    sizes = Counter(want.values())
    assert max(sizes.values()) > 500 and sum(n == 1 for n in sizes.values()) > 100
    assert grouped(spark, texts) == want


def test_segment_tables_reach_all_within_fifteen_bits(spark):
    rng = np.random.default_rng(3)
    spread = [32 * k + i for k in range(8) for i in range(2)][:15]  # two bits in each segment but one
    sketches = []
    for base in rng.integers(0, 2**64, (30, 4), dtype=np.uint64):
        bits = np.unpackbits(base.view(np.uint8), bitorder="little")
        for flip in ([], spread, *[rng.choice(256, n, replace=False) for n in (1, 4, 8, 15, 15, 40)]):
            other = bits.copy()
            other[list(flip)] ^= 1
            sketches.append(np.packbits(other, bitorder="little").view("<i8"))
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sketches)], "s0 long, sketch array<long>")
    at = {}
    for r in s._lookups(nodes).collect():
        at.setdefault(r.key, set()).add(r.s0)
    met = {(i, j) for group in at.values() for i in group for j in group if i < j}
    words = np.array(sketches).view(np.uint64)
    far = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    near = {(i, j) for i, j in zip(*np.nonzero(far <= 15)) if i < j}
    assert len(near) > 200 and near <= met
    assert all(i // 8 == j // 8 for i, j in met)


def test_prefixes_find_only_what_the_segment_tables_leave(spark, monkeypatch):
    rng = random.Random(24)
    texts = [" ".join(w) for k in range(30) for w in family(rng, 4, [0.001], 200)]
    for _ in range(30):
        words = family(rng, 1, [0], 200)[0]
        texts += [" ".join(words), " ".join(edited(rng, words, 0.017))]
    want, alike = exact_groups(texts)
    words = np.array([s.sketch(s.shingles(t)) for t in texts]).view(np.uint64)
    far = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    left = []

    def none_left(slim, rows, nodes, shingle, similarity):
        left.extend(nodes.collect())
        return spark.createDataFrame([], "a long, b long")

    exact = s._by_prefixes
    monkeypatch.setattr(s, "_by_prefixes", none_left)
    first = grouped(spark, texts)
    assert all(first[i] == first[j] for i, j in zip(*np.nonzero((alike >= 0.8) & (far <= 15))))
    assert all(want[i] == want[c] for i, c in first.items()) and first != want  # links of the tables are right, but not all
    assert {r.node: r.known for r in left} == {r.node: first[r.node] for r in left} and len({r.known for r in left}) < len(left)
    monkeypatch.setattr(s, "_by_prefixes", exact)
    assert grouped(spark, texts) == want
