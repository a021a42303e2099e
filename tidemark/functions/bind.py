"""Values computed once a row, however many expressions use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with one more column. No filter on it is pushed below, so what it takes to compute it is done once a row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
