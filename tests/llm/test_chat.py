import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.llm import op5_chat as c

NASTY = st.text(alphabet="<|\\im_endstar>\n \u00e9\U0001f600n", max_size=40)


@given(NASTY)
def test_escapes_are_reversible(text):
    assert "<|" not in c.escape(text) and c.unescape(c.escape(text)) == text
    assert "\n" not in c.escape_name(text) and c.unescape_name(c.escape_name(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x"]), NASTY), max_size=5))
def test_render_reads_back(turns):
    text, spans = c.Template(c.CHATML).render(iter([(i, r, t) for i, (r, t) in enumerate(turns)]))
    assert c.read_back(text) == turns
    assert [c.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    t = c.Template('{# note #}A{% if "x" == "x" and not false %}B{{ "c"|upper ~ 1 }}{% else %}no{% endif %}{% for message in messages %}[{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% endif %}{{ message.content|trim }}]{% endfor %}Z')
    assert t.render(iter([(0, "user", " p "), (1, "user", "q"), (2, "u", "r")]))[0] == "ABC1[1Fp][2q][3Lr]Z"
    assert c.fold(c.parse('a{% if true %}b{{ 1 ~ "c" }}{% endif %}')) == (c.Out(c.Const("ab1c")),)


@pytest.mark.parametrize("bad", ["{{ messages }}", "{{ message.__class__ }}", "{{ message.role }}", "{% for x in messages %}{% endfor %}", "{% if true %}", "{{ open('x') }}", "{% set a = 1 %}", "{{ 1 | nofilter }}", "{% endfor %}", "{{ }}"])
def test_sandbox(bad):
    with pytest.raises(c.TemplateError):
        c.Template(bad)


def test_operator_on_hard_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "assistant", "n"), (4, None, "system", ""), (4, 0, "assistant", "<|im_end|>\n<|im_start|>user\n" * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS spans")
    got = {r.conv_id: r for r in c.digests(c.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 4, None}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[2].n_turns == 1 and got[None].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[4].loss_sha256 == hashlib.sha256(rows[-1][3].encode()).hexdigest()
    assert c.format_conversations(df.limit(0)).count() == 0
