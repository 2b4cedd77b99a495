"""User-defined sources: generators with a state, and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generator(Protocol):
    """Yields one value a row, in order. ``next`` moves on to the first value and from each to the following one."""

    def next(self) -> None: ...

    def value(self) -> object: ...

    def is_null(self) -> bool: ...

    def skip(self, n: int) -> None:
        """Moves over n values; a generator that can jump should."""
        for _ in range(n):
            self.next()


def generated(spark: SparkSession, n: int, make: Callable[[], Generator], returns: str = "long", name: str = "value", order: str = "id", partitions: int | None = None) -> DataFrame:
    """``n`` rows of a generator's values with their position. Each partition makes its own generator and skips to its rows."""
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = make(), 0
        for batch in batches:
            positions = batch.column(0)
            if not len(positions):
                continue
            own.skip(positions[0].as_py() - at)
            values = []
            for _ in range(len(positions)):
                own.next()
                values.append(None if own.is_null() else own.value())
            at = positions[-1].as_py() + 1
            yield pa.record_batch([positions, pa.array(values)], [order, name])

    return base.mapInArrow(run, f"`{order}` long, `{name}` {returns}")


def table_function(function: Callable[..., Iterator[tuple]], returns: str) -> Callable:
    """A Python generator function as a table function: rows for a row, by ``DataFrame.lateralJoin`` or on its own."""

    class Rows:
        def eval(self, *arguments):
            yield from function(*arguments)

    return F.udtf(Rows, returnType=returns)
