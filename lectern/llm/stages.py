"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.storage import table
from lectern.llm.decontamination import find_contamination
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.packing import pack
from lectern.llm.quality import score_quality
from lectern.llm.simhash import drop_near_duplicates, similar_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are.

    Null, empty and short texts fail the base rules.  A row is judged by its text alone, so repeated
    rows stay or go together; a null doc_id is never trusted but judged like any other.  Extra columns
    stay, whatever their names; an empty table gives no rows.
    """
    scored = score_quality(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), table(spark, sf_dir, "labels"), keep=["row"])
    return scored.where("__quality.kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars, if there is one, follows the text.

    Every row stays, also one whose text has lost all of its lines and is empty now.  Null texts stay
    null, with n_chars null; on a tie of doc_id the order of texts decides, repeated rows lose the same
    lines, and a null doc_id comes last.  Extra columns stay; an empty table gives no rows.
    """
    kept = dedup_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id.

    Null, empty and blank texts are one group.  A null doc_id stays only where a group has no other; of
    equal doc_ids the least hash of the text decides, and of repeated rows one stays.  Extra columns
    stay with their row; an empty table gives no rows.
    """
    return drop_near_duplicates(docs, similar_documents(docs, shingle=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together, whatever their doc_id.
    Extra columns stay; an empty table gives no rows, an empty benchmark takes none away.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find_contamination(row, table(spark, sf_dir, "benchmark"), keep=["row"])
    return found.where(F.size("__hits") == 0).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 2048 tokens.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are packed like all
    others.  Only doc_id and text are read; an empty table gives no rows.
    """
    return pack(docs, "word_bpe_49k.json", capacity=2048)
