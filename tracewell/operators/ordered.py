"""Ordered scans of event logs as windows: running counts, first-in-first-out matches, integrals, fills.

Every operator takes the columns that partition the log (a run); without them a log would be one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPTO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def _order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def first_occurrences(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first of the rows that are equal in `same`."""
    w = Window.partitionBy(*same).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def running_sum(df: DataFrame, by: list[str], order: list[str], delta: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(delta).over(_order(by, order).rowsBetween(*_UPTO)))


def max_concurrency(df: DataFrame, by: list[str], order: list[str], delta: Column, name: str = "max_concurrent") -> DataFrame:
    """The largest running sum of delta (+1 begins, -1 ends) of each partition, 0 at least."""
    return running_sum(df, by, order, delta, "_c").groupBy(*by).agg(F.greatest(F.max("_c"), F.lit(0)).alias(name))


def positional_match(df: DataFrame, by: list[str], order: list[str], left: Column, right: Column, cols: list[str]) -> DataFrame:
    """The n-th row for which left holds beside the n-th for which right holds: left_<col> and right_<col>."""
    w = _order(by, order)
    numbered = lambda c, side: df.filter(c).select(*by, F.row_number().over(w).alias("n"), *(F.col(x).alias(f"{side}_{x}") for x in cols))
    return numbered(left, "left").join(numbered(right, "right"), [*by, "n"])


def queue_numbers(df: DataFrame, by: list[str], order: list[str], push: Column, pop: Column, name: str) -> DataFrame:
    """First in, first out, where a pop takes the oldest row that was pushed and is skipped if there is none: the number
    of each push, and for each pop that of the push it takes. Null for skipped pops and all other rows.

    The queue's length is the running sum of +1 and -1 reflected at zero: S - min(0, least S before). The k-th pop
    that finds the queue not empty takes the k-th push.
    """
    w = _order(by, order)
    push, pop = (F.coalesce(c, F.lit(False)) for c in (push, pop & ~F.coalesce(push, F.lit(False))))
    rows = df.withColumn("_push", push).withColumn("_pop", pop).withColumn("_s", F.sum(F.when(F.col("_push"), 1).when(F.col("_pop"), -1).otherwise(0)).over(w.rowsBetween(*_UPTO)))
    before = F.coalesce(F.lag("_s").over(w), F.lit(0))
    low = F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(*_BEFORE)), F.lit(0)))
    rows = rows.withColumn("_taken", F.col("_pop") & (before - low > 0))
    count = lambda c: F.when(F.col(c), F.sum(F.when(F.col(c), 1)).over(w.rowsBetween(*_UPTO)))
    return rows.withColumn(name, F.coalesce(count("_push"), count("_taken"))).drop("_push", "_pop", "_s", "_taken")


def skip_match(df: DataFrame, by: list[str], order: list[str], push: Column, pop: Column, cols: list[str]) -> DataFrame:
    """Each push of queue_numbers beside the pop that takes it: push_<col> and pop_<col>."""
    rows = queue_numbers(df.filter(push | pop).withColumn("_side", push), by, order, F.col("_side"), ~F.col("_side"), "_n")
    side = lambda c, name: rows.filter(c).filter("_n is not null").select(*by, F.col("_n").alias("n"), *(F.col(x).alias(f"{name}_{x}") for x in cols))
    return side(F.col("_side"), "push").join(side(~F.col("_side"), "pop"), [*by, "n"])


def shortage_integral(df: DataFrame, by: list[str], order: list[str], ts: Column, onset: Column, delta: Column, wanted: Column, name: str) -> DataFrame:
    """Sum over rows of max(0, wanted - running sum including the row) times the time since the row before (or onset)."""
    w = _order(by, order)
    rows = df.withColumn("_ready", F.sum(delta).over(w.rowsBetween(*_UPTO)))
    rows = rows.withColumn("_dt", ts - F.coalesce(F.lag(ts).over(w), onset))
    return rows.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), wanted - F.col("_ready")) * F.col("_dt")).alias(name))


def increments(df: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Difference of the next row's value and this one's, for all but the last row."""
    w = _order(by, order)
    out = df.withColumn("_last", F.row_number().over(w) == F.count("*").over(Window.partitionBy(*by)))
    for name, column in values.items():
        out = out.withColumn(name, F.lead(column).over(w) - F.col(column))
    return out.filter("not _last").drop("_last")


def carry_forward(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Blanks (null or empty) take the last value that isn't."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_UPTO)
    for c in columns:
        df = df.withColumn(c, F.last(F.when(F.trim(F.col(c)) != "", F.col(c)), ignorenulls=True).over(w))
    return df


def latest_before(df: DataFrame, by: list[str], order: list[str], begins: Column, ends: Column, cols: list[str]) -> DataFrame:
    """Each end beside the latest begin of the same key before it; ends without one drop out."""
    w = _order(by, order).rowsBetween(*_BEFORE)
    out = df.filter(begins | ends)
    for c in cols:
        out = out.withColumn(f"begin_{c}", F.last(F.when(begins, F.col(c)), ignorenulls=True).over(w))
    return out.filter(ends).filter(F.col(f"begin_{cols[0]}").isNotNull())
