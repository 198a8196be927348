"""Rows of sorted partitions as a stream, for work that goes from group to group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def stream_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, size: int = 4096) -> DataFrame:
    """``work`` sees the rows of a partition in its order and gives rows of ``schema``; no more than ``size`` of them are held."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = iter(work(rows_of(batches)))
        while held := list(islice(made, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
