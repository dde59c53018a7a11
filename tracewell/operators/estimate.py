"""Run time estimates: a random walk (Wiener process) for each task and host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MAX, MIN_NORMAL, normal_quantile


def wiener_estimates(df: DataFrame, alpha: float, now: Column, by: list[str], order: list[str], ms: str = "ms", value: str = "real_time", log: bool = False) -> DataFrame:
    """The alpha quantile of the run time at `now` (an expression over the aggregate last_ms), of each group.

    ms: time of a measurement in milliseconds (double). Steps are differences to the measurement before over the
    square root of the time between; steps without time between are skipped. Their variance grows with the time since
    the last measurement. At alpha = 0.5 the last value itself is the estimate, 2.2e-308 at least. Without two steps
    the estimate is 0. log: values are logarithms.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    dt = F.col(ms) - F.lag(ms).over(w)
    step = F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / F.sqrt(F.when(dt > 0, dt)))
    place = F.struct(*order)
    groups = df.withColumn("_step", step).groupBy(*by).agg(
        F.max_by(value, place).alias("last_value"), F.max_by(ms, place).alias("last_ms"),
        F.var_samp("_step").alias("variance"), F.count("_step").alias("steps"), F.count(value).alias("measurements"),
    )
    last = F.exp("last_value") if log else F.col("last_value")
    if alpha == 0.5:
        estimate = F.greatest(last, F.lit(MIN_NORMAL))
    else:
        spread = F.col("variance") * (now - F.col("last_ms"))
        moved = F.col("last_value") + F.lit(normal_quantile(alpha)) * F.sqrt(F.when(spread > 0, spread))
        walked = F.when(~F.isnan(spread) & (spread > 0), moved).otherwise(F.col("last_value"))
        estimate = F.when(F.col("steps") < 2, 0.0).otherwise(F.exp(walked) if log else F.greatest(walked, F.lit(0.0)))
    return groups.withColumn("estimate", estimate)


def full_matrix(estimates: DataFrame, tasks: DataFrame, hosts: DataFrame, task: str, host: str) -> DataFrame:
    """Estimates of all tasks on all hosts, 0 where there are none: small dimension tables, by design a product."""
    return tasks.select(task).distinct().crossJoin(hosts.select(host).distinct()).join(estimates, [task, host], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))


def mean_cost(matrix: DataFrame, task: str) -> DataFrame:
    """Mean estimate of a task over all hosts, zeros included."""
    return matrix.groupBy(task).agg(F.avg("estimate").alias("mean_cost"))


def sufferage(matrix: DataFrame, task: str, host: str, replicate: bool = False) -> DataFrame:
    """Of each task and asking host: (estimate - least of the other hosts) / mean of the known ones.

    Others count only if known (not 0). An estimate of 0 on the asking host is taken at once (sufferage null, sorts
    first) or, for replicas, counts as the largest double.
    """
    others = Window.partitionBy(task)
    own = F.col("estimate")
    known = F.when(own != 0, own)
    ranked = matrix.withColumn("_sum", F.sum(known).over(others)).withColumn("_n", F.count(known).over(others))
    by_cost = Window.partitionBy(task).orderBy(F.col("_known").asc_nulls_last(), host)
    ranked = ranked.withColumn("_known", known).withColumn("_rank", F.row_number().over(by_cost))
    least, second = (F.min(F.when(F.col("_rank") == r, F.col("_known"))).over(others) for r in (1, 2))
    ranked = ranked.withColumn("_least", least).withColumn("_second", second)
    other = F.coalesce(F.when(F.col("_rank") == 1, F.col("_second")).otherwise(F.col("_least")), F.lit(MAX))
    e = F.when(own == 0, F.lit(MAX)).otherwise(own) if replicate else own
    mean = F.when(own == 0, (e + F.coalesce("_sum", F.lit(0.0))) / (F.col("_n") + 1)).otherwise(F.col("_sum") / F.col("_n"))
    s = (e - other) / mean
    return ranked.withColumn("sufferage", s if replicate else F.when(own != 0, s)).drop("_sum", "_n", "_known", "_rank", "_least", "_second")


def sufferage_picks(scored: DataFrame, task: str, host: str) -> DataFrame:
    """Each host's task: one without an estimate first, then the least sufferage; ties to the smaller task."""
    order = Window.partitionBy(host).orderBy(F.col("sufferage").asc_nulls_first(), task)
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def replayed_marks(df: DataFrame, host: str, ms: str) -> DataFrame:
    """The latest time seen of each host."""
    return df.groupBy(host).agg(F.max(ms).alias("high_water_mark"))
