"""Narrow stages in Python: a function of texts adds one column to every batch of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows that are worked on together: what is made of them is in memory at once.
ROWS = 1000
#: Bytes of text that such rows have together, unless one alone has more.
BYTES = 8 << 20


def bounded(batches: Iterator[pa.RecordBatch], of: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ROWS`` rows and about ``BYTES`` bytes of column ``of``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(of))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            below = ends[at - 1] if at else 0
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, below + BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


def add_column(df: DataFrame, make: Callable[[], Callable[[list], pa.Array]], name: str, kind: str, of: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) with ``name`` of Spark type ``kind`` added.

    ``make`` runs once a task and returns a function from the values of column ``of`` to an Arrow array.
    """
    keep = df.columns if keep is None else keep
    df = df.select(*keep, *([] if of in keep else [of]))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches):
        work = make()
        for batch in bounded(batches, of):
            made = work(batch.column(batch.schema.get_field_index(of)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), made], names=[*keep, name])

    return df.mapInArrow(run, schema)
