"""Token ids as Parquet list columns.

Files hold whole documents in ascending doc_id order.  Ids are dictionary-encoded, counts and doc_ids
delta-encoded (format version 2); row groups and pages are small enough that the page index lets a
reader skip to a few documents, and the metadata columns can be read without the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.storage import new_path
from lectern.llm.arrow import add_column
from lectern.llm.tokenization import encoder, tokenizer_path

#: Writer options: format version 2, dictionaries, row groups of 32 MB, pages of at most 2000 documents or 256 KB.
LAYOUT = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#doc_id": "false", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "compression": "snappy"}


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json") -> None:
    """Write doc_id, part, n_tokens and ids (an end id 0 last) of every document under ``path``.

    Files and rows follow doc_id, null first, then a hash of the text; a null or empty text has the
    end id alone.  Other columns are left behind; an empty table gives no rows.
    """

    def make():
        ids = encoder(tokenizer_path(tokenizer)).ids

        def encode(texts):
            flat, counts = ids(texts, end=True)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.view("<i4"), pa.int32()))

        return encode

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = add_column(ordered, make, "ids", "array<int>", keep=["doc_id"])
    encoded.select("doc_id", F.spark_partition_id().alias("part"), F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**LAYOUT).parquet(path)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, n_tokens and start (ids of all documents before it), read without the ids."""
    index = spark.read.parquet(path).select("doc_id", "part", "n_tokens", F.col("_metadata.row_index").alias("row"))
    return _with_start(index, spark.read.parquet(path)).drop("row")


def _with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Ids in earlier files, a number for each file, and in earlier rows of the same file."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # reads no ids
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return run.join(base, "part").withColumn("start", F.col("base") + F.col("run")).drop("base", "run")


def read_tokens(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, n_tokens and ids; a condition on doc_id reaches row groups and pages."""
    files = spark.read.parquet(path).select("doc_id", "n_tokens", "ids")
    return files if where is None else files.where(where)


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), all from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4").data.cast("B")
            ends = 4 * ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "n_tokens", "row")), crc], names=["doc_id", "part", "n_tokens", "row", "ids_crc32"])

    files = spark.read.parquet(path).select("doc_id", "part", "n_tokens", F.col("_metadata.row_index").alias("row"), "ids")
    kind = dict(files.dtypes)["doc_id"]
    digests = files.mapInArrow(run, f"doc_id {kind}, part int, n_tokens long, row long, ids_crc32 long")
    return _with_start(digests, spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write ``docs`` to new files in the shared folder and digest what is read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer)
    return digest_token_files(docs.sparkSession, path)
