"""Sources: literal rows, generated sequences, Parquet tables and batches of rows with a live-row flag."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType


def values(spark: SparkSession, rows: Iterable[Sequence], names: Sequence[str], types: Sequence[DataType] | None = None) -> DataFrame:
    """Literal rows, nullable 64-bit integers unless ``types`` says otherwise. Rows of another length are an error."""
    rows = [tuple(r) for r in rows]
    if any(len(r) != len(names) for r in rows):
        raise ValueError(f"every row needs {len(names)} values")
    kinds = types or [LongType()] * len(names)
    return spark.createDataFrame(rows, StructType([StructField(n, t, True) for n, t in zip(names, kinds, strict=True)]))


@dataclass(frozen=True)
class Counting:
    """start, start+1, ... and, with ``stop`` (exclusive), from start again."""

    start: int = 0
    stop: int | None = None

    def column(self, position: Column) -> Column:
        if self.stop is None:
            return F.lit(self.start).cast("long") + position
        if self.stop <= self.start:
            raise ValueError("stop must be above start")
        return F.lit(self.start).cast("long") + F.pmod(position, F.lit(self.stop - self.start).cast("long"))


@dataclass(frozen=True)
class Constant:
    """The same value in each row; null is one."""

    value: int | None

    def column(self, position: Column) -> Column:
        return F.lit(self.value).cast("long")


def sequence(spark: SparkSession, n: int, partitions: int | None = None, /, *, order: str | None = None, **columns: Counting | Constant | Column) -> DataFrame:
    """``n`` generated rows. A column is a Counting, a Constant, or any expression of ``id``, the row's position from 0.

    ``order`` names a column to keep the position in. Each value follows from its position alone, so rows are made in
    parallel and columns that are not read cost nothing.
    """
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    position = F.col("id")
    made = [(c.column(position) if isinstance(c, Counting | Constant) else c).alias(name) for name, c in columns.items()]
    return base.select(*([position.alias(order)] if order else []), *made)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; Spark pushes filters and columns into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live_rows(df: DataFrame, live: Column | str = "live") -> DataFrame:
    """Stored batches whose dead rows are flagged: the live rows, without the flag where it is a column's name."""
    out = df.where(F.col(live) if isinstance(live, str) else live)
    return out.drop(live) if isinstance(live, str) else out
