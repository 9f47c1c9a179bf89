"""Runs that repair a stored collection: guards that act, and a re-index whose failures are rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.quality import of_wrong_size, stale
from lectern.sources.store import Store

RUN = "source string, status string, chunks long, message string"


def reindex(store: Store, sources: list[str], chunks_of: Callable[[str], DataFrame]) -> DataFrame:
    """Each source is cut anew and replaces what is stored of it: source, status, chunks and message of each.

    A source that fails, wherever its job does, keeps its stored chunks and tells why; the others go on.
    ``sources`` are the connectors, a handful; one after another, as each of them is a distributed job of its own.
    """
    spark = store.spark
    return spark.createDataFrame([_reindexed(spark, store, s, chunks_of) for s in sources], RUN)


def _reindexed(spark: SparkSession, store: Store, source: str, chunks_of: Callable[[str], DataFrame]) -> tuple:
    try:
        of = spark.createDataFrame([(source,)], "source string")
        store.replace(of, chunks_of(source).select(*store.names))
        return source, "success", store.read().where(F.col("source") == source).count(), None
    except Exception as error:  # whatever a source's job raises belongs to its row
        return source, "error", 0, f"{type(error).__name__}: {str(error).splitlines()[0][:500]}"


def drop_wrong_size(store: Store, dimension: int) -> DataFrame:
    """Collections that hold a vector of another size lose all of their rows; what each has lost."""
    wrong = [r["collection"] for r in of_wrong_size(store.read(), dimension).collect()]
    return store.remove(F.col("collection").isin(wrong) if wrong else F.lit(False)).groupBy("collection").agg(F.sum("deleted").alias("deleted"))


def reindex_stale(store: Store, version: str, chunks_of: Callable[[str], DataFrame]) -> DataFrame:
    """:func:`reindex` of the sources with chunks that neither this version nor its fast path made."""
    old = stale(store.read(), version).where("source is not null").orderBy("source").collect()
    return reindex(store, [r["source"] for r in old], chunks_of)
