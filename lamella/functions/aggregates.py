"""Aggregate functions with their meaning for nulls and no rows spelled out.

All are Spark's own aggregates, computed partially before a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def count_all() -> Column:
    """Rows; 0 for none."""
    return F.count(F.lit(1))


def count_column(x: Column | str) -> Column:
    """Values that are not null; 0 for none."""
    return F.count(x)


def first_value(x: Column | str, order_by: Column | str) -> Column:
    """The first value that is not null in the order of ``order_by``, which should be unique; null if there is none."""
    x = F.col(x) if isinstance(x, str) else x
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    return F.min_by(x, F.when(x.isNotNull(), order))


def min_value(x: Column | str) -> Column:
    """The smallest value that is not null; null if there is none."""
    return F.min(x)


def max_value(x: Column | str) -> Column:
    """The largest value that is not null; null if there is none."""
    return F.max(x)


def sum_i64(x: Column | str) -> Column:
    """The sum of integers with null as 0; 0, not null, for no rows and for nothing but nulls."""
    return F.coalesce(F.sum(x), F.lit(0).cast("long"))


def sum_f64(x: Column | str) -> Column:
    """The same for doubles."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def custom(function: Callable[[pd.Series], object], returns: DataType | str) -> Callable[..., Column]:
    """An aggregate written for a pandas Series. It has no partial form: a group's values meet in one task.

    ``operators.accumulators.accumulate`` takes one that merges.
    """
    kind = {"string": str, "boolean": bool, "double": float, "float": float}.get(returns if isinstance(returns, str) else returns.simpleString(), int)

    def whole(x: pd.Series) -> object:
        return function(x)

    whole.__annotations__ = {"x": pd.Series, "return": kind}
    return F.pandas_udf(whole, returns)
