"""Where vectors come from: any function from a table and a text column to the table with ``embedding``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[DataFrame, str], DataFrame]


def hashed_bag(text: Column, dims: int = 64) -> Column:
    """Unit vector of hashed word counts; all zeros for a text without words.  Stands in for a model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))


def embed(df: DataFrame, column: str, model: Embed | None = None) -> DataFrame:
    """``df`` with ``embedding``: by the model given, else by :func:`hashed_bag`; one that is there stays."""
    if model:
        return model(df, column)
    return df if "embedding" in df.columns else df.withColumn("embedding", hashed_bag(F.col(column)))
