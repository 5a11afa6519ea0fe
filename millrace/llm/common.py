"""Helpers for operators that run Python inside Spark tasks, one Arrow batch at a time."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

#: Rows turned into Python objects at once, so that a batch of long texts stays small.
SLICE_ROWS = 256
#: Entries of each generation of a worker's memo table, where making a value is costly and where it is cheap.
MEMO_ENTRIES, CHEAP_ENTRIES = 100_000, 40_000
#: Longer keys are not kept, so that the size of a memo table in bytes is bounded too.
MEMO_KEY = 64


class Memo(dict):
    """A memo table of bounded size: two generations, the older one is dropped when the younger is full."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > MEMO_KEY:
            return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, schema: T.StructType, start: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Narrow map of df in Arrow batches. start() is called once per task and returns the function
    that takes a slice's columns as lists and gives the output columns as lists or arrays, by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, kinds = start(), arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                # work makes no reference cycles, and memo tables are slow to search for them
                gc.disable()
                out = work(*(c.to_pylist() for c in part.columns))
                gc.enable()
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
