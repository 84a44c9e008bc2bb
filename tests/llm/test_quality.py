import re

import pytest

from lattica.llm import op1_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   \n\t", "a b c", "a b c a b c a b c", "x y z x y z w", "one\ntwo\none\n\n\n two\n two", "#$% &| <>\x0b\x0c tail", "naïve façade glued \U0001f600 ok",
    "the same five words here " * 40, " ".join(f"w{i}" for i in range(300)), "\n".join(["a line of five words"] * 3 + [f"other {i} x y z" for i in range(30)]),
    "LOUD!! " * 80, "ab " * 20_000,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"v{i}", "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None), (3, "a b c", "v3", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, q_n_words string, source string")


def test_measures_match_brute_force(docs):
    got = q.judge(docs.select("doc_id", "text"), order=[r.name for r in q.RULES], always=tuple(q.MEASURES)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == brute(r.text), r.text


def test_order_does_not_change_the_verdict(docs):
    names = [r.name for r in q.RULES]
    verdicts = [{(r.doc_id, r.text): r.q_rejected_by is None for r in q.judge(docs, order=o).collect()} for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {k for k, v in verdicts[0].items() if v}


def test_order_changes_the_work(docs):
    names = [r.name for r in q.RULES]
    cheap, dear = (q.judge(docs.select("doc_id", "text"), order=o).collect() for o in (["few_words", *names[1:]], ["repeated_words", "few_words", *names[2:]]))
    measured = lambda rows: sum(r.q_n_repeat_words is not None for r in rows)
    # Windows are measured only of texts that have enough words, if that rule comes first.
    assert measured(cheap) == sum(brute(t)[0] >= 50 for t in TEXTS) < measured(dear) == len(cheap)
    assert all(r.q_rules_run == 1 and r.q_rejected_by == "few_words" for r in cheap if brute(r.text)[0] < 50)
    assert all(r.q_rules_run == len(names) for r in cheap if r.q_rejected_by is None)


def test_order_is_by_rejection_for_cost_and_repeats(docs):
    first = q.estimate(docs, q.RULES)
    assert first == q.estimate(docs.repartition(5), q.RULES)
    assert [e.name for e in first][0] == "few_words"  # rejects most, at little cost
    names = [e.name for e in first]
    # Once words are counted, shouting is cheaper to find than repeated windows.
    assert names.index("shouting") < names.index("repeated_words")


def test_estimates_and_empty_table(docs):
    found = {e.name: e for e in q.estimate(docs, q.RULES)}
    assert found["few_words"].rejected > 0 and all(e.cost > 0 for e in found.values())
    assert q.filter_quality(docs.limit(0)).count() == 0
