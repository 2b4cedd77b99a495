"""The relational operators. Where arrival order would matter, the order is an argument."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.sources.shared import shared_folder


def filter_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """The rows for which all conditions are true; unknown (null) is not true."""
    for condition in conditions:
        df = df.where(condition)
    return df


def project(df: DataFrame, *passed: str, **computed: Column) -> DataFrame:
    """Columns of the input in any order, repeated under other names if need be, and computed ones."""
    return df.select(*passed, *(c.alias(name) for name, c in computed.items()))


def aggregate(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row with the aggregates of all rows, of none as well."""
    return df.agg(*(c.alias(name) for name, c in aggregates.items()))


def group_aggregate(df: DataFrame, keys: str | Sequence[str], **aggregates: Column) -> DataFrame:
    """A row a group: its keys and aggregates. Null keys are a group; no rows give no groups."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))


def with_group_id(df: DataFrame, key: str, order_by: str, name: str = "group_id") -> DataFrame:
    """Puts a dense id first: 0 for the key that comes first in ``order_by``, 1 for the next new one, and so on.

    A null key has a null id. Only the distinct keys are numbered, in whatever order: they are dealt into ranges of their
    first positions, the bounds of which Spark samples, and a key's id is its range's start plus its place there, so
    neither rows nor keys meet in one task. The ranges are checkpointed, which is a job of its own. A column of the new
    one's name gives way to it.
    """
    rows = df.select(F.struct(*map(_named, df.columns)).alias("row"), _named(key).alias("key"), _named(order_by).alias("at"))
    first = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("at").alias("at"))
    ids = _numbered(first).select(F.col("key").alias("of"), "number")
    joined = rows.join(ids, F.col("key") == F.col("of"), "left")
    return joined.select(F.col("number").alias(name), *(F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != name.lower()))


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _numbered(first: DataFrame) -> DataFrame:
    """``key, number``: the 0-based rank of each key by ``at``, ties by the key."""
    shared_folder(first.sparkSession)
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = first.repartitionByRange(parts, "at", "key").withColumn("range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("at", "key"))
    return ranged.withColumn("place", place).join(starts, "range").select("key", (F.col("start") + F.col("place") - 1).alias("number"))


def cross(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """All pairs of rows, the outer's columns first. The work is the product of the sides; Spark broadcasts one if it is small."""
    return outer.crossJoin(inner)


def theta(outer: DataFrame, inner: DataFrame, condition: Column) -> DataFrame:
    """The pairs of rows for which the condition is true. Without an equality in it the work is the product of the sides.

    ``theta_count`` counts the pairs of one inequality without that.
    """
    return outer.join(inner, condition, "inner")


def theta_count(outer: DataFrame, inner: DataFrame, low: str, high: str, keys: str | Sequence[str], name: str = "n") -> DataFrame:
    """The pairs with the outer's ``low`` below the inner's ``high``, counted by ``keys`` of the outer: a row a group with any.

    The same as ``group_aggregate`` over ``theta``, but no pair is made: for each distinct value the inner's rows above it
    are counted, and each outer row meets one such count. Values are dealt into ranges, the bounds of which Spark samples;
    a count is that of the higher ranges plus that of the higher values of its own, so neither rows nor values meet in one
    task. The ranges are checkpointed, which is a job of its own. A null is below and above nothing; NaN is above all else.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = outer.select(F.struct(*map(_named, keys)).alias("row"), _named(low).alias("low"))
    above = _above(rows.select("low"), inner.select(_named(high).alias("high")))
    counted = rows.join(above, F.col("low") == F.col("at")).groupBy("row").agg(F.sum("above").alias("n"))
    return counted.select(*(F.col("row").getField(c).alias(c) for c in keys), F.coalesce("n", F.lit(0).cast("long")).alias(name))


def _above(lows: DataFrame, highs: DataFrame) -> DataFrame:
    """``at, above``: each distinct low that has any highs above it, and how many."""
    shared_folder(lows.sparkSession)
    points = lows.select(F.col("low").alias("at"), F.lit(True).alias("asked"), F.lit(0).cast("long").alias("n"))
    points = points.unionAll(highs.select("high", F.lit(False), F.lit(1).cast("long"))).where(F.col("at").isNotNull())
    points = points.groupBy("at").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"))
    ranged = points.repartitionByRange("at").withColumn("range", F.spark_partition_id()).checkpoint()  # small ranges may be merged
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.min("at").alias("from"), F.sum("n").alias("n"))  # one row a range
    ends = sizes.select("range", F.coalesce(F.sum("n").over(before.orderBy(F.col("from").desc())), F.lit(0)).alias("beyond"))
    own = F.coalesce(F.sum("n").over(before.partitionBy("range").orderBy(F.col("at").desc())), F.lit(0))
    counts = ranged.withColumn("own", own).where("asked").join(ends, "range")
    return counts.select("at", (F.col("beyond") + F.col("own")).alias("above")).where(F.col("above") > 0)


def limit_rows(df: DataFrame, n: int, order_by: str | Column | Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in that order, or all of fewer."""
    order = list(order_by) if isinstance(order_by, list | tuple) else [order_by]
    return df.orderBy(*order).limit(n)


def top_n(df: DataFrame, n: int, key: str, tiebreak: str | Sequence[str]) -> DataFrame:
    """The ``n`` rows of the largest key, largest first, ties by ``tiebreak`` upward. Rows with a null key drop out."""
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    return df.where(F.col(key).isNotNull()).orderBy(F.col(key).desc(), *ties).limit(n)


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Operators one after another, each a function of a frame, the reader's own among them."""
    for step in steps:
        df = df.transform(step)
    return df
