"""Models as columns: loaded once a Python worker, asked in batches of a bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.functions.embedding import Embed

#: From a table of the inputs to a value for each row.
Model = Callable[[pd.DataFrame], pd.Series]
_loaded: dict[str, Model] = {}


def loaded(key: str, load: Callable[[], Model]) -> Model:
    """The model of this worker process, loaded when it is first asked for."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def with_model(df: DataFrame, key: str, load: Callable[[], Model], inputs: list[str], name: str, kind: T.DataType, batch: int = 64) -> DataFrame:
    """``df`` with the column ``name``: what the model says to the columns ``inputs`` of each row.

    ``load`` runs once a worker for each ``key``, which names the model and its version; a worker serves many tasks.
    The model sees ``batch`` rows at a time, in which any input may be null.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        model = loaded(key, load)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rows = whole.slice(at, batch)
                told = model(pa.Table.from_batches([rows]).select(inputs).to_pandas())
                made = pa.array(list(told), kinds)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in kept), made], names=[*kept, name])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(kind)
    return df.select(*dict.fromkeys([*kept, *inputs])).mapInArrow(run, schema)


def embedding_model(key: str, load: Callable[[], Model], batch: int = 64) -> Embed:
    """A model of texts as what the chunker takes for one; the model is given a table with the one column ``text``."""

    def model(df: DataFrame, column: str) -> DataFrame:
        named = df.withColumn("__input", df[column])
        wrapped = lambda: _of_column(load(), "__input")
        return with_model(named, f"embedding {key}", wrapped, ["__input"], "embedding", T.ArrayType(T.DoubleType()), batch).drop("__input")

    return model


def _of_column(model: Model, column: str) -> Model:
    return lambda rows: model(rows.rename(columns={column: "text"}))
