"""Questions to the provenance model, over DataFrames of invocations, runs, tasks and files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions import schema as S
from ..storage import stored

#: Exit codes of containers that were released, killed or terminated: fixed values of the cluster manager and the system.
KILLED = (-100, 137, 143)


def complete() -> Column:
    """Host, task and run time are known."""
    return F.col("host").isNotNull() & F.col("task_id").isNotNull() & (F.col("task_id") != 0) & F.col("real_time").isNotNull()


@dataclass
class Store:
    """invocations (run_id, invoc_id, task_id, host, timestamp, real_time, ...), runs (run_id, wf_name), tasks (task_id,
    task_name), files (run_id, invoc_id, file, size, real_time_in, real_time_out)."""

    invocations: DataFrame
    runs: DataFrame
    tasks: DataFrame
    files: DataFrame | None = None
    access: list[Row] = field(default_factory=list)

    def host_names(self) -> DataFrame:
        return self.invocations.filter("host is not null").select("host").distinct()

    def task_ids_for_workflow(self, name: str) -> DataFrame:
        """Tasks of all runs of a workflow."""
        named = self.runs.filter(F.col("wf_name") == name).select("run_id")
        return self.invocations.join(named, "run_id", "left_semi").filter("task_id <> 0").select("task_id").distinct()

    def task_name(self, task_id: int) -> DataFrame:
        """No row for an unknown task, one for any other: of several names the least."""
        return self.tasks.filter(F.col("task_id") == task_id).select("task_id", "task_name").orderBy("task_name").limit(1)

    def entries_for_tasks(self, ids: Iterable[int]) -> DataFrame:
        """Complete invocations of any of the tasks; none for an empty list."""
        return self._nested(self.invocations.filter(F.col("task_id").isin(list(ids))).filter(complete()))

    def entries_on_host_since(self, task_id: int, host, since: int, inclusive: bool = False) -> DataFrame:
        """Complete invocations of a task on a host after a time; the time itself counts only if inclusive. Invocations
        that haven't ended have the time -1."""
        at = F.coalesce("timestamp", F.lit(-1))
        late = at >= since if inclusive else at > since
        return self._nested(self.invocations.filter((F.col("task_id") == task_id) & (F.col("host") == host) & late).filter(complete()))

    def _nested(self, found: DataFrame) -> DataFrame:
        return found if self.files is None else with_files(found, self.files)

    def timed(self, name: str, ask: Callable[[], DataFrame], wf_name: str = "", quiet: str = "NOAT") -> DataFrame:
        """Runs a question once, stores its answer, and keeps a record of its time and its number of rows, unless the
        workflow's name says not to."""
        tick, seen = time.time_ns() // 1_000_000, Observation()
        out = stored(ask().observe(seen, F.count(F.lit(1)).alias("rows")))
        if quiet not in wf_name:
            tock = time.time_ns() // 1_000_000
            self.access.append(Row(function=name, wf_name=wf_name, tick=tick, tock=tock, took=tock - tick, rows=seen.get["rows"]))
        return out


def split_direction(files: DataFrame) -> DataFrame:
    """is_input where there is a stage-in time, is_output where there is a stage-out time; a file may be both."""
    return files.withColumn("is_input", F.col("real_time_in").isNotNull()).withColumn("is_output", F.col("real_time_out").isNotNull())


def nested_files(files: DataFrame) -> DataFrame:
    """(run_id, invoc_id, input, output): maps from file name to (size, real_time) of invocations that have files."""
    f = split_direction(files)

    def of(flag: str, took: str) -> Column:
        pairs = F.collect_list(F.when(F.col(flag), F.struct("file", F.struct("size", F.col(took).alias("real_time")))))
        return F.map_from_entries(pairs)

    return f.groupBy("run_id", "invoc_id").agg(of("is_input", "real_time_in").alias("input"), of("is_output", "real_time_out").alias("output"))


def with_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Invocations with the maps of nested_files(); those without files have empty maps."""
    nested = nested_files(files)
    empty = F.map_from_entries(F.array().cast("array<struct<file:string,v:struct<size:bigint,real_time:bigint>>>"))
    return found.join(nested, ["run_id", "invoc_id"], "left").withColumn("input", F.coalesce("input", empty)).withColumn("output", F.coalesce("output", empty))


def joined(invocations: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Invocations beside their run and their task; without either they drop out."""
    names = tasks.select("task_id", "task_name")
    return invocations.drop("task_name", "wf_name").join(runs.select("run_id", "wf_name"), "run_id").join(names, "task_id")


def counters(events: DataFrame, by: list[str], kind: str, exit_code: str) -> DataFrame:
    """Containers requested, allocated, completed (with success or failure), failed, and killed (exit codes KILLED)."""
    n = lambda c, name: F.count_if(c).alias(name)
    k, code = F.col(kind), F.col(exit_code)
    done, killed = k == S.COMPLETED, code.isin(*KILLED)
    return events.groupBy(*by).agg(
        n(k == S.REQUESTED, "requested"), n(k == S.ALLOCATED, "allocated"), n(done & ~killed, "completed"), n(done & ~killed & (code != 0), "failed"), n(done & killed, "killed")
    )
