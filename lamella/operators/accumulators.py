"""Aggregates written in Python that can be merged: partial states are made before the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Accumulator(Protocol):
    """A state that rows are added to, that merges with another one, and that has a result. States are pickled."""

    def zero(self) -> object: ...

    def add(self, state: object, rows: pa.RecordBatch) -> object: ...

    def merge(self, one: object, other: object) -> object: ...

    def result(self, state: object) -> object: ...


#: Groups whose states a task holds before it hands them on.
HELD = 10_000


def accumulate(df: DataFrame, keys: str | Sequence[str], columns: Sequence[str], accumulator: Accumulator, returns: str, name: str = "value") -> DataFrame:
    """A row a group: its keys and the accumulator's result over ``columns``. Null keys are a group; no rows give no groups.

    A task holds the states of HELD groups at most, so a group of any size is a few states by the time it is shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width = len(keys)
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    of_keys = ", ".join(f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(width))
    types = rows.limit(0).toArrow().schema

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}

        def handed() -> pa.RecordBatch:
            values = [pa.array([k[i] for k in states], types.field(i).type) for i in range(width)]
            return pa.record_batch([*values, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*(f"k{i}" for i in range(width)), "state"])

        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)):
                places.setdefault(key, []).append(at)
            inputs = batch.select(range(width, batch.num_columns))
            for key, some in places.items():
                states[key] = accumulator.add(states[key] if key in states else accumulator.zero(), inputs.take(pa.array(some)))
            if len(states) >= HELD:
                yield handed()
                states = {}
        if states:
            yield handed()

    def final(key: tuple, group: pa.Table) -> pa.Table:
        state = None
        for x in group.column("state"):
            one = pickle.loads(x.as_py())
            state = one if state is None else accumulator.merge(state, one)
        return pa.table([*(group.column(i).slice(0, 1) for i in range(width)), pa.array([accumulator.result(state)])], [*(f"k{i}" for i in range(width)), "value"])

    merged = rows.mapInArrow(partial, f"{of_keys}, state binary").groupBy(*(f"k{i}" for i in range(width))).applyInArrow(final, f"{of_keys}, value {returns}")
    return merged.toDF(*keys, name)
