"""Mixing sources to target weights by Pareto order sampling.

A source's target, divided by its size, says how often each of its documents should come on average. The whole part of that number is
allocated as certain copies; for the rest documents are ranked by random odds divided by inclusion odds, U/(1-U) / (p/(1-p)),
with U a hash of the id, and the first of that order are taken once more until their words make up what the target lacks.
The sample's size is thus fixed in words, and a rerun takes the same documents. The cut in each source's order is found by
repeated histograms (:func:`weighted_splits`); with it, a row's copies follow from the row alone, so texts are never shuffled.

The registered query prefers longer documents (:func:`by_length`): inclusion grows with the square root of a document's words, between bounds, so ranks weigh
random odds by unequal inclusion odds. Preferences are rounded to eighths of a power of two, which gives at most ``LEVELS`` of them for each source: what a source takes at any rate
follows from its words at each level, counted once.

Defined results: ties in rank (equal ids in one source) are taken together; a very long text counts whole; a preference that is null, not a number or not positive counts as the least;
a null or empty text has size 0 and takes 0 words; a null source is a source of its own, the last; repeated rows
are taken alike, so a source whose rows mostly repeat one id comes less near its target; sources of size 0 have target 0 and get no copies; an empty table gives an
empty table. Columns of the input pass through; the operator's own replace columns of the same name (``OWN``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, unit_hash, weighted_splits

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Preferences lie between 2**-OCTAVES and 2**OCTAVES, in steps of an eighth.
OCTAVES = 8
LEVELS = 16 * OCTAVES + 1
#: Columns that the operator adds; input columns of these names are replaced.
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
#: The driver holds a row for each source, and so does each executor; beyond this many, group them first.
MAX_SOURCES = 100_000


def targets(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of all sizes by weight, each at most cap times its size; what lies above is dealt again by weight among the others."""
    out = [0.0] * len(sizes)
    total, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def by_length(size: Column) -> Column:
    """A preference for longer documents: the square root of the words, as a share of that of 400, between a half and two."""
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.sqrt(size / 400.0)))


def _level(preference: Column) -> Column:
    """A preference, rounded to an eighth of a power of two."""
    step = F.round(F.log2(preference) * 8)
    step = F.when(preference > 0, F.greatest(F.lit(-8.0 * OCTAVES), F.least(F.lit(8.0 * OCTAVES), step))).otherwise(-8.0 * OCTAVES)
    return F.pow(F.lit(2.0), F.coalesce(F.nanvl(step, F.lit(-8.0 * OCTAVES)), F.lit(-8.0 * OCTAVES)) / 8)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 10, source: str = "source", id_col: str = "doc_id", text: str = "text", preference: Column | Callable[[Column], Column] | None = None
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies, how often the mix takes the row.

    Sources in code point order, null last, get the weights in turn. preference: a positive number, as a column or as a function of the size; inclusion in a source is in
    proportion to it as far as the cap on copies allows (default: alike for all rows).
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"),  # apart from the operator's own names
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("mix_size"),
        F.col(source).cast("string").alias("mix_source"),
        F.col(id_col).alias("mix_id"),
        *([_level(preference.cast("double")).alias("mix_pref")] if isinstance(preference, Column) else []),
    )
    if not isinstance(preference, Column):
        sized = sized.withColumn("mix_pref", F.lit(1.0) if preference is None else _level(preference(F.col("mix_size")).cast("double")))
    own = [F.col(f"mix_row.`{c}`") for c in docs.columns if c not in OWN]
    slim = materialize(sized.drop("mix_row"), "mix")
    found = slim.groupBy("mix_source").agg(F.sum("mix_size").alias("size")).orderBy(F.col("mix_source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    if not found:
        return sized.select(*own, "mix_size", *[F.lit(None).cast(t).alias(n) for n, t in (("mix_source_size", "long"), ("mix_target", "double"), ("mix_copies", "int"))])
    names, sizes = [r["mix_source"] for r in found], [int(r["size"]) for r in found]
    goal = targets([float(s) for s in sizes], [weights[i % len(weights)] for i in range(len(sizes))], cap)

    def with_rates(rows: DataFrame, rates: list[float], cuts: list[int]) -> DataFrame:
        table = spark.createDataFrame(list(zip(names, range(len(names)), sizes, goal, rates, cuts)), "mix_name string, mix_no int, mix_source_size long, mix_target double, mix_rate double, mix_cut long")
        return rows.join(F.broadcast(table), F.col("mix_source").eqNullSafe(F.col("mix_name")), "left")

    often = F.least(F.lit(cap), F.col("mix_rate") * F.col("mix_pref"))
    whole = F.floor(often + 1e-12)
    p = F.greatest(F.lit(0.0), often - whole)
    # Pareto's rank q, as q / (1 + q) on a scale of 2**60.
    u = (unit_hash(F.col("mix_id"), F.lit(seed)) + F.lit(0.5)) / float(1 << 62)
    q = (u / (1 - u)) / (p / (1 - p))
    key = F.when(p > 1e-12, (q / (1 + q) * float(1 << 60)).cast("long"))

    rates = [g / s if s else 0.0 for g, s in zip(goal, sizes)]
    if preference is not None:
        rates = _rates(slim, names, goal, cap)
    known = with_rates(slim, rates, [0] * len(names)).select("mix_no", "mix_size", whole.alias("whole"), key.alias("key"))
    certain = {r["mix_no"]: int(r["n"] or 0) for r in known.groupBy("mix_no").agg(F.sum(F.col("whole") * F.col("mix_size")).alias("n")).collect()}
    lack = {i: goal[i] - certain.get(i, 0) for i in range(len(names)) if goal[i] - certain.get(i, 0) > 1e-6 * max(1.0, goal[i])}
    cut = weighted_splits(known.where("key IS NOT NULL"), "mix_no", "key", "mix_size", lack, tolerance=1e-7)
    out = with_rates(sized, rates, [int(cut.get(i, 0)) for i in range(len(names))])
    copies = F.when(F.col("mix_size") > 0, whole + F.coalesce((key < F.col("mix_cut")).cast("int"), F.lit(0))).otherwise(F.lit(0)).cast("int")
    return out.select(*own, "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def _rates(slim: DataFrame, names: list[str | None], goal: list[float], cap: float) -> list[float]:
    """For each source the rate r at which the sum of min(cap, r * preference) * size is the target."""
    levels: dict[str | None, list[tuple[float, int]]] = {}
    for r in slim.where("mix_size > 0").groupBy("mix_source", "mix_pref").agg(F.sum("mix_size").alias("n")).collect():
        levels.setdefault(r["mix_source"], []).append((r["mix_pref"], int(r["n"])))
    out = []
    for name, target in zip(names, goal):
        rate, rest, left = 0.0, float(target), sorted(levels.get(name, []), reverse=True)
        # The most preferred reach the cap first.
        while left and rest > 0:
            rate = rest / sum(p * n for p, n in left)
            if rate * left[0][0] <= cap:
                break
            rest -= cap * left.pop(0)[1]
        out.append(rate)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    took = mix(rows, **options).where("mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return took.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, preference=by_length).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken")
    )
