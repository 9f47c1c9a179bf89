"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six white-space characters U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def body(text: str | Column = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than the six white-space characters."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+", -1))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does just that where every character has one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def identity() -> Column:
    """A 64-bit name for a document that holds where doc_id is null or repeated: rows alike in both share it.

    Documents are told apart by doc_id and this name together (:func:`same_document`), so two texts
    can only be taken for one if they also share their doc_id.
    """
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """The condition of a join on ident and doc_id, null ids included."""
    return (left["ident"] == right["ident"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of all columns: whatever their names, none clashes with what is added."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def unwrapped(rows: DataFrame, columns: list[str], added: str) -> DataFrame:
    """The columns that were wrapped and ``added``, which takes the place of one of that name."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns if c != added), added)


def documents_only(docs: DataFrame) -> DataFrame:
    """doc_id and text; extra columns, whatever their names, are left behind."""
    return docs.select("doc_id", "text")
