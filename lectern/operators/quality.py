"""Upkeep of collections, and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scores import finite

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def integrity(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points, sources and points without a source of each collection that should be there, and whether it is."""
    have = chunks.groupBy("collection").agg(F.count("*").alias("points"), F.count_distinct("source").alias("sources"), F.count_if(F.col("source").isNull()).alias("orphans"), F.count_if(F.col("chunk_id").isNull()).alias("without_id"))
    joined = targets.join(have, "collection", "left").withColumn("missing", F.col("points").isNull())
    return joined.na.fill(0, ["points", "sources", "orphans", "without_id"])


def integrity_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("points").alias("points"), F.sum("orphans").alias("orphans"), F.count_if("missing").alias("missing"))


def points(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("points"))


def of_wrong_size(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.groupBy("collection").agg(F.max(F.size("embedding") != dimension).alias("wrong")).where("wrong").select("collection")


def stale(chunks: DataFrame, version: str) -> DataFrame:
    """Sources with chunks that neither this version nor its fast path made."""
    return chunks.where(~F.coalesce(F.col("chunker_version").isin(version, f"{version}-fastpath"), F.lit(False))).groupBy("source").agg(F.count("*").alias("chunks"))


def source_status(registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """Declared sources with their last run."""
    last = jobs.groupBy("source").agg(F.max_by(F.struct("id", "status"), F.struct("finished_at", "id")).alias("last"))
    return registry.join(last, "source", "left").select("source", "last.id", F.coalesce("last.status", F.lit("never")).alias("status"))


def reindex_report(results: DataFrame) -> DataFrame:
    """By source what was made and what failed; an error of one is a row of its own, not the end of all."""
    return results.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count("error").alias("errors"))


def evaluation_rows(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with the texts retrieved in order of rank and the answer, both empty if there are none."""
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    joined = questions.join(listed, "query_id", "left").join(answers, "query_id", "left")
    return joined.withColumns({"contexts": F.coalesce("contexts", F.array().cast("array<string>")), "answer": F.coalesce("answer", F.lit(""))})


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    joined = rows.join(scores, "query_id", "left")
    return joined.withColumns({m: F.coalesce(m, F.lit(float("nan"))) for m in METRICS})


def metric_means(rows: DataFrame) -> DataFrame:
    """Mean of each metric over its numbers, NaN if there are none."""
    long = rows.unpivot(["query_id"], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(F.coalesce(F.avg(finite(F.col("value"))), F.lit(float("nan"))).alias("mean"))


def admitted(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows, or an error if there are more than the limit; without one all are admitted."""
    if limit is not None and rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def score_band(x: Column) -> Column:
    number = finite(x)
    return F.when(number.isNull(), "none").when(number >= 0.8, "good").when(number >= 0.6, "fair").when(number >= 0.4, "weak").otherwise("poor")
