"""Python over many small groups: partitions sorted by key, so that a task walks its groups in one pass.

``applyInPandas`` costs milliseconds a group; this costs a batch. Memory: one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of output gathered before they leave the task.
OUT_ROWS = 2_000


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[tuple, list[dict]], list[tuple]], schema: str | StructType) -> DataFrame:
    """``f(key, rows)`` for every group, rows as dicts in order; its tuples have the columns of ``schema``.

    A null key is a group of its own.
    """
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(rows(batches), key=lambda r: tuple(r[k] for k in keys)):
            out += f(key, list(group))
            if len(out) >= OUT_ROWS:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)
