"""Division and logarithm with the results of C doubles, where Spark would raise or give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with ``x`` as a lambda's variable: evaluated once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def c_div(a: Column, b: Column) -> Column:
    """a / b: 0/0 is NaN, x/0 an infinity, and NaN stays NaN; null gives null."""
    return bind(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), lambda v: _c_div(v["a"], v["b"]))


def _c_div(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def c_ln(x: Column) -> Column:
    """ln(x): below 0 NaN, at 0 minus infinity; null gives null."""
    return bind(x.cast("double"), lambda v: F.when(F.isnan(v) | (v < 0), F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(F.ln(v)))


def not_below_zero(x: Column) -> Column:
    """Negative and negative zero become 0; NaN passes."""
    return bind(x, lambda v: F.when(v <= 0, F.lit(0.0)).otherwise(v))
