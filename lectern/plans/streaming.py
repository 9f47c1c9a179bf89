"""Streaming queries (J), each drained and comparable with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.storage import new_path
from lectern.operators import workspace as W
from lectern.plans.chunking import PLAIN, chunks_sql, letter_counts
from lectern.plans.registry import query
from lectern.plans.views import Views
from lectern.plans.workspace import BOOSTS, STATE
from lectern.streaming import jobs as J


def _stream(v: Views, name: str) -> DataFrame:
    """A table of the input directory as a stream of its files."""
    path = f"{v.sf_dir}/{name}.parquet"
    # A pattern, as a stream takes a single file for a folder otherwise.
    return J.read_stream(v.spark, f"{path}*", v.spark.read.parquet(path).schema)


def _drained(v: Views, df: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    out = new_path(v.spark, "drained")
    J.to_batches(df, out, new_path(v.spark, "stream"), mode=mode).awaitTermination()
    return J.current(v.spark, out, keys)


CHUNKS = "doc_id long, source string, chunk_id string, chunk long, heading string, chunker_version string, text string"


@query("j01_ingest", chunks_sql(PLAIN))
def _(v):
    """Every document comes three times: as it was, with its text as it is now, and, in part, once more."""
    docs, first = v.documents.select("doc_id", "source", "text"), new_path(v.spark, "documents")
    for number, lot in enumerate((docs.withColumn("text", F.concat(F.lit("Old. "), F.col("doc_id").cast("string"))), docs, docs.where("doc_id % 3 = 0")), 1):
        lot.withColumn("version", F.lit(number)).write.mode("append").parquet(first)
    store = J.Store(v.spark, new_path(v.spark, "chunks"), CHUNKS, ("source", "doc_id"), slots=8)
    # Each lot has a file for each part of the documents.
    stream = J.read_stream(v.spark, first, v.spark.read.parquet(first).schema, docs.rdd.getNumPartitions())
    J.ingest(stream, store, new_path(v.spark, "stream"), letter_counts).awaitTermination()
    return store.read().select("doc_id", "chunk_id", "chunk", "heading", "chunker_version", F.md5("text").alias("digest"))


@query("j02_redelivery", "select event_id % 500 chunk_id from events group by 1")
def _(v):
    chunks = _stream(v, "events").select((F.col("event_id") % 500).alias("chunk_id"), F.col("ts").cast("timestamp").alias("arrived_at"))
    return _drained(v, J.once(chunks, "60 days"), ["chunk_id"], "append").select("chunk_id")


def _jobs(v: Views) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error")
    return _stream(v, "events").select(F.col("ts").cast("timestamp").alias("finished_at"), (F.col("user_id") % 4).alias("source"), status.alias("status"))


@query("j03_outcomes_per_day", "select strftime(finished_at, '%Y-%m-%d') as day, source, count_if(status = 'success') success, count_if(status = 'error') error from jobs_v group by 1, 2")
def _(v):
    found = _drained(v, J.outcomes(_jobs(v)), ["start", "source"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "source", "success", "error")


@query("j03_outcomes_sliding", """select strftime(time_bucket(interval 12 hour, finished_at) - b * interval 12 hour, '%Y-%m-%d %H') as start, source, count_if(status = 'success') success, count_if(status = 'error') error
  from jobs_v, range(2) r(b) group by 1, 2""")
def _(v):
    found = _drained(v, J.outcomes(_jobs(v), "1 day", "12 hours"), ["start", "source"])
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "source", "success", "error")


def _state(v: Views) -> DataFrame:
    vote = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("none")
    asked = F.concat(F.lit("R00"), 1 + F.col("event_id") % 7)
    votes = _stream(v, "events").select((F.col("event_id") % 100).alias("analysis_id"), asked.alias("requirement_id"), (F.col("user_id") % 5).alias("user_id"), vote.alias("vote"), F.col("ts").alias("updated_at"), "event_id")
    return _drained(v, J.latest_votes(votes), J.VOTE_KEY)


@query("j04_feedback_totals", f"with {STATE} select analysis_id, count_if(vote = 'up') up, count_if(vote = 'down') down from state group by 1")
def _(v):
    return J.feedback_totals(_state(v))


@query("j04_running_boosts", BOOSTS)
def _(v):
    return J.running_boosts(_state(v), v.sources, W.owners(v.cdcs, v.clients))
