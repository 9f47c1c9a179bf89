"""Streaming jobs: incremental ingestion, redelivery, job outcomes and running feedback.

A job writes what each micro-batch makes to a folder of that batch, which a batch that runs again
replaces; :func:`current` reads the latest row of each key.  So a batch costs what it holds, whatever has
come before, and nothing is gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.embedding import Embed
from lectern.functions.storage import scratch
from lectern.operators.chunking import chunk_documents
from lectern.operators.workspace import source_boosts
from lectern.sources.store import Store


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def to_batches(stream: DataFrame, out: str, checkpoint: str, make=None, mode: str = "append") -> StreamingQuery:
    """All that is there now, what ``make`` makes of each batch under ``out/batch=<number>``."""

    def write(batch: DataFrame, number: int) -> None:
        made = make(batch) if make else batch
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The rows of the latest batch of each key."""
    rows = spark.read.parquet(out)
    last = F.max("batch").over(Window.partitionBy(*keys))
    return rows.withColumn("last", last).where("batch = last").drop("batch", "last")


def ingest(documents: DataFrame, store: Store, checkpoint: str, model: Embed | None = None) -> StreamingQuery:
    """New and changed documents (doc_id, source, text, and ``version`` if there is one) to chunks in ``store``.

    The unit of ``store`` is a document: its chunks are replaced by those of its latest version, and a document that
    has become null or blank loses them.  Of several rows of a document in one micro-batch the one of
    the highest ``version`` counts, else that of the greatest hash of its text.  A batch costs its own
    documents and the slots that these lie in; a batch that runs again leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = F.struct(*([F.col("version")] if "version" in batch.columns else []), F.xxhash64(F.coalesce("text", F.lit(""))))
        latest = batch.groupBy("doc_id", "source").agg(F.max_by("text", order).alias("text"))
        with scratch(batch.sparkSession):
            store.replace(latest, chunk_documents(latest, model).select(*store.names), covered=True)

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def once(chunks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Chunks without those that arrive again within the delay."""
    return chunks.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["chunk_id"])


def outcomes(jobs: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Successes and errors by window and source; in update mode rows later than the watermark don't count."""
    span = F.window("finished_at", window, slide) if slide else F.window("finished_at", window)
    counts = jobs.withWatermark("finished_at", delay).groupBy(span.alias("w"), "source").agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("error"))
    return counts.select(F.col("w.start").alias("start"), "source", "success", "error")


VOTE_KEY = ["analysis_id", "requirement_id", "user_id"]


def latest_votes(votes: DataFrame) -> DataFrame:
    """The last valid vote of each analysis, requirement and user so far, in update mode: a changed vote replaces the one before."""
    valid = votes.where(F.col("vote").isin("up", "down"))
    return valid.groupBy(*VOTE_KEY).agg(F.max_by("vote", F.struct("updated_at", "event_id")).alias("vote"))


def feedback_totals(state: DataFrame) -> DataFrame:
    """Votes by analysis, of the votes that stand."""
    return state.groupBy("analysis_id").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))


def running_boosts(state: DataFrame, sources: DataFrame, owned: DataFrame) -> DataFrame:
    """Boosts of the sources that stand up-voted now."""
    return source_boosts(state, sources, owned)
