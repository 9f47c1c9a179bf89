"""Gapless ranks without one task that sees all rows: range partitions, then places inside the written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import materialize


def ranked(rows: DataFrame, order: list[Column], label: str, within: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order``) and ``total``, both within equal ``within`` or of all.

    Where ``within`` is named, ``order`` must begin with it; it must not be null.  Rows are exchanged
    once by range and written sorted; a rank is the row's place in its file and a base for that file,
    of which there is a row for each file and value.
    """
    of = [within] if within else []
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    files = materialize(parted, label).select("*", F.col("_metadata.row_index").alias("at"))
    starts = files.groupBy("part", *of).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    run = Window.partitionBy(*of).orderBy("part") if of else Window.orderBy("part")
    every = Window.partitionBy(*of) if of else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = starts.select("part", *of, (before - F.col("low")).alias("shift"), F.sum("n").over(every).alias("total"))
    return files.join(base, ["part", *of]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")
