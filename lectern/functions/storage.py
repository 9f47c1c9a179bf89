"""Tables and intermediate results in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder.  A written table cuts lineage, survives the loss of an
executor and can be read column by column, which an RDD checkpoint cannot.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no folder of its own.
LOCAL_ROOT = "file:///tmp/checkpoints/lectern"
_written: list[str] = []
_writer: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_ROOT


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when Python ends."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    _writer[path] = threading.get_ident()
    return path


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer parts than there are, so at most 128 MB for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what this thread wrote to the shared folder inside it.

    For long-lived sessions: results must be written or collected inside, as a lazy one still reads
    the tables behind it.
    """
    before = {*_written}
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before and _writer.get(p) == threading.get_ident()]:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)
        _writer.pop(path, None)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if any(path.endswith(p.rsplit("/", 1)[1]) for p in _written):
            remove(df.sparkSession, next(p for p in _written if path.endswith(p.rsplit("/", 1)[1])))


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in [*_written]:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            return
