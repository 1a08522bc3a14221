"""Null and number rules.

Research data marks missing numbers with NaN, and most statistics skip them.
Spark skips NULL but not NaN, sorts NaN above every number and, under ANSI
rules, raises on division by zero.  Every source therefore passes through
:func:`nan_to_null`, and ratios go through :func:`ratio`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


#: Decimal places to which means are compared: far above what the order of summation changes.
COMPARED_PLACES = 6


def larger_flag(left: Column | str, right: Column | str) -> Column:
    """1 where ``left > right`` at COMPARED_PLACES; 0 otherwise, also when either side is missing.

    The small shift keeps values that lie on a rounding edge from going either way.
    """
    a, b = (F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), COMPARED_PLACES) for c in (left, right))
    return F.when(a > b, 1).otherwise(0)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)


def clip_negative(value: Column | str) -> Column:
    """Replace negative numbers by zero; missing stays missing."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


def sum_or_zero(value: Column | str) -> Column:
    """Sum in which a group without any number counts as zero."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def product_or_one(value: Column | str) -> Column:
    """Product that skips missing factors; one when there is none."""
    return F.coalesce(F.product(value), F.lit(1.0))


def product_strict(value: Column) -> Column:
    """Product that is NULL as soon as one factor is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.product(value))


def as_id(value: Column | str) -> Column:
    """Numeric firm identifier; text that is not a number becomes NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return v.cast("string").try_cast("double").try_cast("bigint")


def keep_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose grouping keys are missing, before they form a group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)
