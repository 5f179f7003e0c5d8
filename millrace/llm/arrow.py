"""Running a function on Arrow batches, in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from millrace.session import ship

#: Rows handled together inside a batch: bounds what a function holds besides its input.
ROWS_A_PIECE = 512


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with ``fn`` from a slice of a batch to a dict of columns (None: no rows)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_PIECE):
                out = fn(batch.slice(at, ROWS_A_PIECE))
                if out is not None:
                    yield pa.record_batch([_as(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
