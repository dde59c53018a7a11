"""Folds of an event log into the provenance model: runs, tasks, invocations, files, texts and engine events.

Of several entries for one attribute the last wins; task, language and (by default) time stamp are the first one's.
Order is (source, line_no). Folds are plain aggregations, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.scalar import real_time, real_time_or_one



def _order() -> Column:
    return F.struct("source", "line_no")


def _last(key: str, value: Column | str = "value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.when((F.col("key") == key) & value.isNotNull(), _order()))


def runs(entries: DataFrame) -> DataFrame:
    """(run_id, wf_name, wf_time, task_ids): name and time of the last entries; the set of its tasks."""
    time = F.col("value").try_cast("long")
    return entries.filter("run_id is not null").groupBy("run_id").agg(
        _last(S.WF_NAME).alias("wf_name"), _last(S.WF_TIME, time).alias("wf_time"),
        F.sort_array(F.collect_set(F.when(F.col("task_id") != 0, F.col("task_id")))).alias("task_ids"),
    )


def tasks(entries: DataFrame) -> DataFrame:
    """(task_id, task_name, lang) as first seen; 0 means no task."""
    known = entries.filter("task_id is not null and task_id <> 0")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), _order())).alias(c)
    return known.groupBy("task_id").agg(first("task_name"), first("lang"))


def invocations(entries: DataFrame, timestamp: str = "first") -> DataFrame:
    """One row for each run and invocation (0 means none).

    timestamp: that of the "first" entry, of the "last", or of the "time" entry (-1 as long as there is none).
    """
    own = entries.filter("invoc_id is not null and invoc_id <> 0 and run_id is not null")
    ran = F.when(F.col("key") == S.TIME, F.col("timestamp"))
    stamp = {"first": F.min_by("timestamp", _order()), "last": F.max_by("timestamp", _order()), "time": F.coalesce(F.max_by(ran, F.when(ran.isNotNull(), _order())), F.lit(-1).cast("long"))}
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), _order())).alias(c)
    value = F.col("value")
    return own.groupBy("run_id", "invoc_id").agg(
        first("task_id"), first("task_name"), first("lang"), stamp[timestamp].alias("timestamp"), _last(S.HOST).alias("host"),
        _last(S.TIME_SCHED, real_time(value)).alias("schedule_time"), _last(S.TIME, real_time_or_one(value)).alias("real_time"),
        _last(S.TIME_STAGE_IN, real_time(value)).alias("real_time_in"), _last(S.TIME_STAGE_OUT, real_time(value)).alias("real_time_out"),
        _last(S.STDOUT).alias("stdout"), _last(S.STDERR).alias("stderr"),
    )


def files(entries: DataFrame) -> DataFrame:
    """One row for each run, invocation and file; size is shared by both directions, the last one wins."""
    own = entries.filter("file is not null and invoc_id is not null and invoc_id <> 0 and run_id is not null")
    sizes, value = F.col("key").isin(S.FILE_SIZE_IN, S.FILE_SIZE_OUT), F.col("value")
    size = F.when(sizes, value.try_cast("long"))
    return own.groupBy("run_id", "invoc_id", "file").agg(
        F.max_by(size, F.when(size.isNotNull(), _order())).alias("size"),
        _last(S.FILE_TIME_IN, real_time(value)).alias("real_time_in"), _last(S.FILE_TIME_OUT, real_time(value)).alias("real_time_out"),
    )


def texts(entries: DataFrame) -> DataFrame:
    """Scripts (input) and outputs of invocations, every entry a row."""
    kind = F.when(F.col("key") == S.SCRIPT, "input").when(F.col("key") == S.OUTPUT, "output")
    part = F.when(F.col("key") == S.SCRIPT, S.EXEC).otherwise(S.OUTPUT)
    return entries.withColumn("type", kind).filter("type is not null").select("run_id", "invoc_id", part.alias("keypart"), F.col("value").alias("content"), "type")


def events(entries: DataFrame, latest: bool = False) -> DataFrame:
    """(run_id, type, content) of engine events: all of them, or the latest of each type."""
    own = entries.filter(S.is_event()).withColumn("type", F.get_json_object("value", "$.type"))
    if latest:
        return own.groupBy("run_id", "type").agg(F.max_by("value", _order()).alias("content"))
    return own.select("run_id", "type", F.col("value").alias("content"))
