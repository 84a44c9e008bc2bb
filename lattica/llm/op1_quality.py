"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule names the measures it needs and says when it rejects. On a sample the cascade estimates what each rule costs and which rows it rejects, and
puts first the rule that rejects most for its cost, next the one that does so among the rows and measures that are then left, and so on. Costs are counted, not
timed: a measure costs so much for each character or word of the text, so that reruns find the same order.
:func:`filter_quality` measures for each rule what is not yet measured and drops what it rejects before the next one, so costly measures run on the survivors of cheap
ones. :func:`judge` is the report on all rows: the first rule in that order that rejects, how many rules ran, and measures, of which those not in ``always`` are taken
only of rows that no earlier rule rejected, and are null elsewhere.

Defined results: a null text counts as empty; an empty text has no words and fails ``few_words``; a very long text is measured whole, with an array of its words in one row;
a value that just equals a rule's bound is not rejected; documents are judged
row by row, so repeated rows, null ids and null columns pass through unchanged; an empty table gives an empty table. Columns of the
input are kept; columns that :func:`judge` adds start with ``q_`` and replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_of

#: Separators that end words.
SPACES = " \t\n\x0b\x0c\r"
#: Symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"


def _removed(text: str, chars: str) -> Column:
    """How many of the characters the text holds."""
    return (F.length(text) - F.length(F.translate(F.col(text), chars, ""))).cast("long")


@dataclass(frozen=True)
class Measure:
    """layers: successive projections; each maps the text's column name and the word array's name to new columns. Costs are relative: of a character, of a word."""

    layers: list[Callable[[str, str], dict[str, Column]]]
    words: bool = False
    per_char: float = 1.0
    per_word: float = 0.0


def _window_layers() -> list[Callable[[str, str], dict[str, Column]]]:
    # Windows with equal hashes are neighbours once sorted; positions of those windows cover the repeated words.
    def hashes(_t, w):
        n = F.size(w)
        window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return {"q_h": F.when(n >= 6, F.transform(F.sequence(F.lit(0), n - 3), window)).when(n == 4, F.transform(F.sequence(F.lit(0), F.lit(1)), window)).when(n == 5, F.transform(F.sequence(F.lit(0), F.lit(2)), window)).when(n >= 0, F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i"))))}

    def ordered(_t, _w):
        return {"q_s": F.when(F.size(F.array_distinct(F.col("q_h.h"))) < F.size("q_h"), F.array_sort("q_h")).when(F.col("q_h").isNotNull(), F.slice("q_h", 1, 0)), "q_h": F.lit(None)}

    def again(_t, _w):
        same = lambda x, k: F.coalesce(x["h"] == F.get("q_s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("q_s", k + 1)["h"], F.lit(False))
        return {"q_p": F.sort_array(F.transform(F.filter("q_s", same), lambda x: x["i"]))}

    def covered(_t, _w):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return {"q_n_repeat_words": F.aggregate("q_p", start, step, lambda a: a["n"]), "q_s": F.lit(None), "q_p": F.lit(None)}

    return [hashes, ordered, again, covered]


#: Every measure is null where its text is null.
MEASURES: dict[str, Measure] = {
    "q_n_words": Measure([lambda t, w: {"q_n_words": F.regexp_count(F.col(t), F.lit(WORD)).cast("long")}], per_char=6.0),
    "q_word_chars": Measure([lambda t, w: {"q_word_chars": F.length(F.translate(F.col(t), SPACES, "")).cast("long")}]),
    "q_n_symbols": Measure([lambda t, w: {"q_n_symbols": _removed(t, SYMBOLS)}]),
    "q_n_shouts": Measure([lambda t, w: {"q_n_shouts": _removed(t, "!")}]),
    "q_lines": Measure([
        lambda t, w: {"q_l": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)},
        lambda t, w: {"q_n_lines": F.size("q_l").cast("long"), "q_n_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"), "q_l": F.lit(None)},
    ], per_char=3.0),
    "q_n_repeat_words": Measure(_window_layers(), words=True, per_char=8.0, per_word=100.0),
}


@dataclass(frozen=True)
class Rule:
    """needs: names in MEASURES; rejects: over their columns."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column] = field(compare=False)


#: The base rules of the contract come first in this list; the cascade finds its own order.
BASE_RULES = [
    Rule("few_words", ("q_n_words",), lambda: F.col("q_n_words") < 50),
    Rule("repeated_words", ("q_n_words", "q_n_repeat_words"), lambda: 100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words")),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", ("q_n_words", "q_n_symbols"), lambda: 10 * F.col("q_n_symbols") > F.col("q_n_words")),
    Rule("word_length", ("q_n_words", "q_word_chars"), lambda: (F.col("q_word_chars") < 2 * F.col("q_n_words")) | (F.col("q_word_chars") > 15 * F.col("q_n_words"))),
    Rule("shouting", ("q_n_words", "q_n_shouts"), lambda: 4 * F.col("q_n_shouts") > F.col("q_n_words")),
    # A text of a few lines may repeat one of them and be sound.
    Rule("repeated_lines", ("q_lines",), lambda: (F.col("q_n_dup_lines") >= 3) & (100 * F.col("q_n_dup_lines") > 30 * F.col("q_n_lines"))),
]


def _measured(df: DataFrame, names: list[str], done: set[str], apart: bool = False) -> DataFrame:
    """df with the measures of q_text. apart: behind a generator, so that no filter above is moved below and measures anew."""
    names = [x for x in names if x not in done]
    if not names:
        return df
    before = df.columns
    if any(MEASURES[x].words for x in names):
        df = df.withColumn("q_w", F.when(F.col("q_text").isNotNull(), words_of(F.col("q_text"))))
    for depth in range(max(len(MEASURES[x].layers) for x in names)):
        new: dict[str, Column] = {}
        for x in names:
            if depth < len(MEASURES[x].layers):
                new |= MEASURES[x].layers[depth]("q_text", "q_w")
        df = df.withColumns(new)
    done.update(names)
    df = df.drop("q_w", "q_h", "q_s", "q_p", "q_l")
    if apart:
        measured = [c for c in df.columns if c not in before]
        df = df.select(*[F.col(f"`{c}`") for c in before], F.inline(F.array(F.struct(*measured))))
    return df


@dataclass(frozen=True)
class Estimate:
    """Of one rule on the sample rows that reach it: cost for each document and the share rejected."""

    name: str
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, text: str = "text") -> list[Estimate]:
    """The rules in the cascade's order, with cost and selectivity, from about ``sample_rows`` rows drawn by a hash of the row.

    One job measures the sample; the driver gets a row for each set of rules that reject the same rows.
    """
    total = docs.count()
    if not total:
        return [Estimate(r.name, 1.0, 0.0) for r in rules]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    drawn = docs.where(F.pmod(F.xxhash64(*plain, F.lit(17)), F.lit(total)) < sample_rows).select(F.coalesce(F.col(text), F.lit("")).alias("q_text"))
    every = sorted({m for r in rules for m in r.needs} | {"q_n_words"})
    fails = F.concat(*[F.when(r.rejects(), "1").otherwise("0") for r in rules]).alias("fails")
    found = _measured(drawn, every, set()).groupBy(fails).agg(F.count("*").alias("n"), F.sum(F.length("q_text")).alias("chars"), F.sum("q_n_words").alias("words")).collect()
    cost = lambda names, r: sum(MEASURES[m].per_char * (r["chars"] + 30 * r["n"]) + MEASURES[m].per_word * r["words"] for m in names)
    left, done, out = list(range(len(rules))), set(), []
    while left:
        reach = [r for r in found if all(r["fails"][rules.index(rule)] == "0" for rule in (rules[i] for i in range(len(rules)) if i not in left))]
        n = max(1, sum(r["n"] for r in reach))
        of = [Estimate(rules[i].name, (sum(cost(set(rules[i].needs) - done, r) for r in reach) or n) / n, sum(r["n"] for r in reach if r["fails"][i] == "1") / n) for i in left]
        best = max(range(len(left)), key=lambda k: (of[k].rank, -of[k].cost, -left[k]))
        out.append(of[best])
        done.update(rules[left.pop(best)].needs)
    return out


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, text: str = "text", order: list[str] | None = None) -> list[Rule]:
    """The rules in the order of :func:`estimate`; or, without measuring, as order names them."""
    if order is None:
        order = [e.name for e in estimate(docs, rules, sample_rows, text)]
    return sorted(rules, key=lambda r: order.index(r.name))


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", always: tuple[str, ...] = (), **options) -> DataFrame:
    """docs with measures, q_rejected_by: the first rule, in the cascade's order, that rejects the row, or null, and q_rules_run: how many were tried.

    Which rows are rejected does not depend on the order; which of several rules is named does.
    """
    rules = ordered(docs, RULES if rules is None else rules, text=text, **options)
    done: set[str] = set()
    own = [c for c in docs.columns if c not in ("q_text", "q_rejected_by", "q_rules_run", "q_all")]
    df = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(text), F.lit("")).alias("q_text"))
    df = _measured(df, list(always), done, apart=True)
    df = df.withColumn("q_rejected_by", F.lit(None).cast("string")).withColumn("q_rules_run", F.lit(0))
    for r in rules:
        if not done.issuperset(r.needs):  # of rows that are rejected by now, nothing more is measured
            df = df.withColumn("q_all", F.col("q_text")).withColumn("q_text", F.when(F.col("q_rejected_by").isNull(), F.col("q_text")))
            df = _measured(df, list(r.needs), done, apart=True).withColumn("q_text", F.col("q_all")).drop("q_all")
        open_ = F.col("q_rejected_by").isNull()
        df = df.withColumns({"q_rules_run": F.col("q_rules_run") + open_.cast("int"), "q_rejected_by": F.when(open_ & r.rejects(), F.lit(r.name)).otherwise(F.col("q_rejected_by"))})
    return df.drop("q_text")


def filter_quality(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", **options) -> DataFrame:
    """The documents that no rule rejects, with docs' own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")  # apart from the measures' names
    df, done = docs.select(whole, F.coalesce(F.col(text), F.lit("")).alias("q_text")), set()
    for r in ordered(docs, RULES if rules is None else rules, text=text, **options):
        df = _measured(df, list(r.needs), done, apart=True).where(~r.rejects())
    return df.select(*[F.col(f"q_row.`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the measures, base_failed and kept for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The contract has these measures of every row; what else rules need is taken of rows that are still in.
    judged = judge(docs, always=("q_n_words", "q_word_chars", "q_n_symbols", "q_lines", "q_n_repeat_words"))
    failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return judged.select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("q_rejected_by").isNull()).alias("kept"),
    )


#: What SQL says of each document; the rules' order has no part in it.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(ln.n, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * shouts > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM f
"""
