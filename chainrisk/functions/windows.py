"""Window helpers with explicit order and bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def forward_fill(value: Column | str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Last known value up to and including the row."""
    w = _ordered(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def lagged(value: Column | str, n: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(value, n).over(_ordered(keys, order))


def lead_by(value: Column | str, n: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lead(value, n).over(_ordered(keys, order))


def rolling_product(
    value: Column | str, rows: int, keys: Sequence[str], order: Sequence[str], leading: bool = False
) -> Column:
    """Product over ``rows`` rows ending at (or, if ``leading``, starting at) the row.

    NULL unless the frame holds ``rows`` rows; missing factors are skipped.
    """
    w = _ordered(keys, order)
    w = w.rowsBetween(0, rows - 1) if leading else w.rowsBetween(1 - rows, 0)
    full = F.count(F.lit(1)).over(w) == rows
    return F.when(full, F.coalesce(F.product(value).over(w), F.lit(1.0)))


def running_offsets(
    df: DataFrame, keys: Sequence[str], order: str, amount: str, block: int = 1024
) -> DataFrame:
    """Sum of ``amount`` over the earlier rows of the key, as column ``offset``.

    A plain running sum puts a whole key into one task.  Here the integer
    ``order`` column is cut into blocks: sums per block, running sums over the
    few block rows, and running sums inside each block.  No task ever holds
    more than one block of a key plus the block totals.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    by_block = [*keys, "_block"]
    before = W.unboundedPreceding, -1
    totals = blocked.groupBy(*by_block).agg(F.sum(amount).alias("_block_sum"))
    starts = totals.select(
        *by_block,
        F.coalesce(
            F.sum("_block_sum").over(_ordered(keys, ["_block"]).rowsBetween(*before)), F.lit(0)
        ).alias("_start"),
    )
    inside = F.coalesce(
        F.sum(amount).over(_ordered(by_block, [order]).rowsBetween(*before)), F.lit(0)
    )
    return (
        blocked.withColumn("_inside", inside)
        .join(starts, by_block)
        .withColumn("offset", F.col("_start") + F.col("_inside"))
        .drop("_block", "_start", "_inside")
    )
