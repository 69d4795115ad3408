"""Running a Python function over Arrow batches without going through pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, fn: Callable[..., list], schema: str, prepare: Callable[[], object] | None = None) -> DataFrame:
    """Applies ``fn`` to the columns of each batch, as Python lists in order of ``df``.

    ``fn`` returns the columns of ``schema`` as lists of equal length (any length, so
    rows may be dropped or multiplied).  ``prepare``, if given, runs once a worker task
    and its result is the first argument of ``fn``.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [prepare()] if prepare else []
        for b in batches:
            if b.num_rows == 0:
                continue
            out = fn(*first, *[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)
