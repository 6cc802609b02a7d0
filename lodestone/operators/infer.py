"""Batch inference: one operator that runs an injected model over a column of any table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

# A factory builds the model; the model maps a list of inputs to a list of outputs of the same length.
Model = Callable[[list], Sequence[Any]]
Factory = Callable[[], Model]

# A worker holds the models of this many calls, the latest ones: a plan that alternates reader and generator keeps both.
KEPT = 2
# Rows whose results a worker holds before they leave it (at least one call's), however many rows an Arrow batch has.
ROWS_OUT = 256
_LOADED: dict[str, Model] = {}


def loaded(key: str, factory: Factory) -> Model:
    """The model of this Python worker; built on first use and kept for later tasks until ``KEPT`` others are used."""
    model = _LOADED.pop(key, None)
    if model is None:
        while len(_LOADED) >= KEPT:
            del _LOADED[next(iter(_LOADED))]
        model = factory()
    _LOADED[key] = model
    return model


def _answered(
    batch: pa.RecordBatch, model: Model, names: list[str], output: str, kind: pa.DataType, batch_size: int
) -> Iterator[pa.RecordBatch]:
    """``batch`` with the column ``output``, in slices of whole calls."""
    step = max(ROWS_OUT // batch_size, 1) * batch_size
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        columns = [part.column(n).to_pylist() for n in names]
        values = columns[0] if len(columns) == 1 else list(zip(*columns))
        results: list[Any] = []
        for lo in range(0, len(values), batch_size):
            piece = values[lo:lo + batch_size]
            out = list(model(piece))
            if len(out) != len(piece):
                raise ValueError(f"the model returned {len(out)} results for {len(piece)} inputs")
            results.extend(out)
        yield pa.RecordBatch.from_arrays(part.columns + [pa.array(results, kind)], names=batch.schema.names + [output])


def run(
    df: DataFrame, factory: Factory, inputs: str | list[str], output: str, output_type: DataType | str = "string",
    batch_size: int = 16, num_partitions: int | None = None, key: str | None = None,
) -> DataFrame:
    """``df`` plus the column ``output``, the model's result for the column(s) ``inputs``.

    One input column is passed as a list of values, several as a list of tuples. ``num_partitions`` spreads the rows
    evenly first, for models that cost more than a shuffle. The model is built once per Python worker for this call;
    calls with the same ``key`` share it.
    """
    if isinstance(output_type, str):
        output_type = _parse_datatype_string(output_type)
    names = [inputs] if isinstance(inputs, str) else list(inputs)
    schema = StructType(df.schema.fields + [StructField(output, output_type)])
    key = key or uuid.uuid4().hex
    arrow_type = to_arrow_type(output_type)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                model = loaded(key, factory)
            yield from _answered(batch, model, names, output, arrow_type, batch_size)

    rows = df.repartition(num_partitions) if num_partitions else df
    return rows.mapInArrow(apply, schema)
