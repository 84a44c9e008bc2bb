"""Token counts by a byte-pair vocabulary, and what of a model's context they take."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import RESERVED, context_limit, fits, utilization

#: The vocabulary if none is given.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of the whole text; none for a null text. path: a tokenizers file that every executor has."""
    place = path or vocabulary()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        t = _tokenizer(place)
        return pd.Series([len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts], dtype="int64")

    return count(text)


def usage(rows: DataFrame, model: Column, text: str = "text", reserve: int = RESERVED, path: str | None = None) -> DataFrame:
    """rows with tokens, max_context, available_input, reserve_output, fits (no margin), fits_with_margin (a tenth kept free) and utilization_percent."""
    limit = context_limit(model)
    counted = rows.withColumn("tokens", token_count(F.col(text), path)).withColumn("max_context", limit)
    free = F.col("max_context") - reserve
    return counted.select(
        "*", free.alias("available_input"), F.lit(reserve).alias("reserve_output"), (F.col("tokens") <= free).alias("fits"),
        fits(F.col("tokens"), F.col("max_context"), reserve).alias("fits_with_margin"), utilization(F.col("tokens"), F.col("max_context"), reserve).alias("utilization_percent"),
    )
