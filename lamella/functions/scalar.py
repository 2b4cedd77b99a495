"""Scalar functions as column expressions, and the way in for functions written in Python.

All give null where an argument is null. Integer overflow is an error, as in ANSI SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def negate(x: Column | str) -> Column:
    return -_column(x)


def add(x: Column | str, y: Column | str) -> Column:
    return _column(x) + _column(y)


def multiply(x: Column | str, y: Column | str | int) -> Column:
    return _column(x) * (F.lit(y) if isinstance(y, int) else _column(y))


def int_div(x: Column | str, k: int) -> Column:
    """Division that truncates toward zero, within 64 bits."""
    return F.call_function("div", _column(x), F.lit(k))


def bucket(x: Column | str, size: int = 10, start: int = 13) -> Column:
    """``x % size + start``; the remainder has the sign of x."""
    return _column(x) % F.lit(size) + F.lit(start)


def vectorized(function: Callable[..., pd.Series], returns: DataType | str) -> Callable[..., Column]:
    """A function of pandas Series as a column function; batches cross to Python by Arrow. Built-ins are faster."""
    return F.pandas_udf(function, returns)


def null_aware(function: Callable[[pd.Series], pd.Series]) -> Callable[..., Column]:
    """A predicate of one column in pandas that sees nulls and decides on them itself; it must say true or false."""

    def test(x: pd.Series) -> pd.Series:
        return function(x).astype(bool)

    return F.pandas_udf(test, "boolean")


def null_rejecting(function: Callable[[pd.Series], pd.Series]) -> Callable[..., Column]:
    """A predicate of one column in pandas, false for null whatever the function says."""

    def test(x: pd.Series) -> pd.Series:
        return function(x).fillna(False).astype(bool) & x.notna()

    return F.pandas_udf(test, "boolean")
