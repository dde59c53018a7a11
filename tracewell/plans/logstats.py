"""Statistics of workflow runs from their event logs.

Cleaning and matching follow file order, everything after that the order of time with ties in file order. Each run
(source) is a partition of its own, so that runs are worked on side by side. All steps are windows and sums within runs,
over rows that are read once: a log dealt out by run goes from its entries to its statistics without another exchange, and
nothing of it is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.scalar import real_time, shutdown, startup
from ..operators.ordered import queue_numbers

PHASES = ["sched", "startup", "stage_in", "exec", "stage_out", "shutdown"]
BY, FILE_ORDER, TIME_ORDER = ["source"], ["line_no"], ["timestamp", "line_no"]


def _type() -> Column:
    return F.when(S.is_event(), F.get_json_object("value", "$.type"))


def _container() -> Column:
    return F.get_json_object("value", "$.container-id")


def cleaned(entries: DataFrame) -> DataFrame:
    """Without repeated entries, and without containers that ended with an exit code other than 0."""
    # the first of equal entries, combined before the shuffle
    rows = entries.groupBy(*BY, *S.FIELDS).agg(F.min("line_no").alias("line_no")).withColumn("type", _type())
    rows = rows.withColumn("container", F.when(F.col("type").isNotNull(), _container()))
    ended = F.col("type") == S.COMPLETED
    rows = rows.withColumn("_bad", F.coalesce(F.when(ended, F.get_json_object("value", "$.exit-code").try_cast("int") != 0), F.lit(False)))
    # a container ends with a bad entry for all of its allocations in the run
    held = Window.partitionBy(*BY, "container")
    gone = F.col("container").isNotNull() & F.col("_gone") & F.coalesce(F.col("type") == S.ALLOCATED, F.lit(False))
    return rows.withColumn("_gone", F.max("_bad").over(held)).filter(~F.col("_bad") & ~gone).drop("_bad", "_gone")


def expanded(rows: DataFrame) -> DataFrame:
    """Cleaned entries whose engine events carry the invocation they belong to.

    A request takes the oldest waiting exec entry, if any. The n-th completion belongs to the n-th run time, and with
    it the latest allocation of its container before that run time.
    """
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    push, pop, begun, ended, took = is_("key", S.EXEC), is_("type", S.REQUESTED), is_("type", S.ALLOCATED), is_("type", S.COMPLETED), is_("key", S.TIME)
    own = ["invoc_id", "task_id", "task_name", "lang"]
    upto = Window.partitionBy(*BY).orderBy(*FILE_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.when(c, F.sum(F.when(c, 1)).over(upto))
    out = queue_numbers(rows, BY, FILE_ORDER, push, pop, "_asked").withColumn("_ended", F.coalesce(count(ended), count(took)))
    # what takes and what is taken have the same number: even ones for requests, odd ones for completions
    out = out.withColumn("_pair", F.coalesce(F.col("_asked") * 2, F.col("_ended") * 2 + 1)).drop("_asked", "_ended")
    pair = Window.partitionBy(*BY, "_pair")
    giver = F.when(F.col("_pair").isNotNull() & (push | took), F.struct(*own, F.col("line_no").alias("at")))
    out = out.withColumn("_told", F.first(giver, ignorenulls=True).over(pair))
    out = out.withColumn("_told", F.when(F.col("_pair").isNotNull() & (pop | ended), F.col("_told"))).drop("_pair")
    # a completion stands where its run time does; an allocation before it, without another one between, belongs to it
    at = F.when(begun, F.col("line_no")).when(ended, F.col("_told.at"))
    held = Window.partitionBy(*BY, "container").orderBy("_at")
    out = out.withColumn("_at", at).withColumn("_next", F.lead(F.when(ended, F.col("_told"))).over(held))
    out = out.withColumn("_told", F.when(begun & F.col("container").isNotNull(), F.col("_next")).otherwise(F.col("_told")))
    for c in own:
        out = out.withColumn(c, F.coalesce(F.col(f"_told.{c}"), c))
    return out.drop("_told", "_next", "_at")


def invocations(rows: DataFrame) -> DataFrame:
    """One row for each run and invocation with its host, phases and product of input sizes (1.0 without files)."""
    return _folded(rows.filter("invoc_id is not null"))


def _folded(rows: DataFrame, waited: Column | None = None, *of_run: str) -> DataFrame:
    """Invocations; one row for each run's entries of none, if there are any; with the sum of waited, and columns of runs."""
    order = F.struct(*TIME_ORDER)
    last = lambda c, v: F.max_by(v, F.when(c & v.isNotNull(), order))
    key, kind, took = F.col("key"), F.col("type"), real_time(F.col("value"))
    t = F.col("timestamp")
    size = F.when(key == S.FILE_SIZE_IN, F.col("value").try_cast("double"))
    folded = rows.groupBy(*BY, "invoc_id").agg(
        F.min_by("task_name", order).alias("task_name"), last(key == S.HOST, F.col("value")).alias("host"),
        last(key == S.TIME_SCHED, took).alias("sched"), last(kind == S.ALLOCATED, t).alias("startup_ts"),
        last(key == S.TIME_STAGE_IN, took).alias("stage_in"), last(key == S.TIME_STAGE_IN, t).alias("stage_in_ts"),
        last(key == S.TIME, took).alias("exec"), last(key == S.TIME, t).alias("exec_ts"),
        last(key == S.TIME_STAGE_OUT, took).alias("stage_out"), last(key == S.TIME_STAGE_OUT, t).alias("stage_out_ts"),
        last(kind == S.COMPLETED, t).alias("shutdown_ts"), F.coalesce(F.product(size), F.lit(1.0)).alias("file_size"),
        *([] if waited is None else [F.sum(waited).alias("no_task_ready")]), *(F.first(c).alias(c) for c in of_run),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return folded.select(
        *BY, "invoc_id", "task_name", "host", "exec_ts", "file_size", zero("sched"), startup(F.col("stage_in_ts"), F.col("startup_ts"), F.col("sched")).alias("startup"),
        zero("stage_in"), zero("exec"), zero("stage_out"), shutdown(F.col("shutdown_ts"), F.col("stage_out_ts"), F.col("stage_out")).alias("shutdown"),
        *([] if waited is None else ["no_task_ready"]), *of_run,
    )


def averages(rows: DataFrame, by: list[str], phases: list[str] = PHASES) -> DataFrame:
    """Averages of the phases, cut off towards 0, and the number of invocations."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("invocations"), *(F.sum(p).alias(p) for p in phases))
    return sums.select(*by, "invocations", *(F.expr(f"{p} div invocations").alias(p) for p in phases))


def statistics(entries: DataFrame) -> DataFrame:
    """One row for each run: containers at once at most, run time, time without a ready task, phases, idle time.

    idle = containers * run time - time without a ready task - the average phases. A run without invocations has no row.
    """
    rows, kind, order = expanded(cleaned(entries)), F.col("type"), F.struct(*TIME_ORDER)
    begins, ends = F.coalesce(kind == S.ALLOCATED, F.lit(False)), F.coalesce(kind == S.COMPLETED, F.lit(False))
    w = Window.partitionBy(*BY).orderBy(*TIME_ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = lambda v, key: F.coalesce(F.last(F.when(F.col("key") == key, F.struct(v.alias("v"))), ignorenulls=True).over(whole)["v"], F.lit(0))
    rows = rows.withColumn("_c", F.sum(F.when(begins, 1).when(ends, -1).otherwise(0)).over(upto))
    rows = rows.withColumn("_ready", F.sum(F.when(F.col("key") == S.EXEC, 1).when(ends, -1).otherwise(0)).over(upto)).withColumn("_before", F.lag("timestamp").over(w))
    rows = rows.withColumn("onset", latest(F.col("timestamp"), S.WF_NAME)).withColumn("runtime", latest(F.col("value").try_cast("long"), S.WF_TIME))
    rows = rows.withColumn("max_concurrent", F.greatest(F.max("_c").over(whole), F.lit(0)))
    waited = F.greatest(F.lit(0), F.col("max_concurrent") - F.col("_ready")) * (F.col("timestamp") - F.coalesce("_before", "onset"))
    of_run = ["max_concurrent", "runtime"]
    folded = _folded(rows, waited, *of_run)
    sums = folded.groupBy(*BY).agg(
        F.count("invoc_id").alias("invocations"), *(F.sum(F.when(F.col("invoc_id").isNotNull(), F.col(p))).alias(p) for p in PHASES),
        *(F.first(c).alias(c) for c in of_run), F.sum("no_task_ready").alias("no_task_ready"),
    ).filter("invocations > 0")
    means = sums.select(*BY, "invocations", *(F.expr(f"{p} div invocations").alias(p) for p in PHASES), *of_run, "no_task_ready")
    idle = F.col("max_concurrent") * F.col("runtime") - F.col("no_task_ready") - sum((F.col(p) for p in PHASES), F.lit(0))
    return means.withColumn("idle", idle)


def report(entries: DataFrame) -> DataFrame:
    """The long form: one row for each run and task name with the average phases."""
    return averages(invocations(expanded(cleaned(entries))), [*BY, "task_name"])


def sorted_report(entries: DataFrame) -> DataFrame:
    """The long form in the order of runs and task names."""
    return report(entries).orderBy(*BY, "task_name")


def wide_report(entries: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each run, six columns for each task name. Names are found by a distinct, or given."""
    return report(entries).groupBy(*BY).pivot("task_name", names).agg(*(F.first(p).alias(p) for p in PHASES))
