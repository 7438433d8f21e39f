"""Window helpers.  Partitions are keys at day grain, so a calendar bounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from fieldtally.functions.expressions import col
from fieldtally.operators.scan import DecayedMean, running_fold


def top_ranked(df: DataFrame, order: list[Column], tie_break: list[str], k: int, name: str) -> DataFrame:
    """First k rows with their global RANK.

    The limit comes first (a distributed top-k), and the one-partition rank then
    sees k rows only.  Ranks of the first k rows never depend on later rows.
    """
    head = df.orderBy(*order, *tie_break).limit(k)
    return head.withColumn(name, F.rank().over(Window.orderBy(*order)).cast("bigint"))


def top_ranked_by(df: DataFrame, part: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """Rows of rank <= k inside each partition; Spark prunes each task's groups first."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.rank().over(w).cast("bigint")).where(F.col(name) <= k)


def trailing_mean(c, n: int, w: WindowSpec) -> Column:
    return F.avg(col(c)).over(w.rowsBetween(-(n - 1), 0))


def trailing_sum(c, n: int, w: WindowSpec) -> Column:
    return F.sum(col(c)).over(w.rowsBetween(-(n - 1), 0))


def rolling_mean(c, n: int, min_n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows, NULL values skipped, NULL below min_n values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) >= min_n, F.avg(col(c)).over(frame))


def prior_stats(c, n: int, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Mean, sample sd and row count of the n rows before the current one."""
    frame = w.rowsBetween(-n, -1)
    return (
        F.avg(col(c)).over(frame),
        F.stddev_samp(col(c)).over(frame),
        F.count(F.lit(1)).over(frame),
    )


def ffill(c, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ewm(df: DataFrame, key: list[str], ts: str, c: str, name: str, span: int = 7, min_n: int = 3) -> DataFrame:
    """``df`` with the recursive exponentially weighted mean (no adjustment), gaps decay by position."""
    return running_fold(df, key, ts, c, name, DecayedMean(span, min_n))
