"""Live logs: entries as a stream, and estimates that are refreshed with each batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import MIN_NORMAL, normal_quantile
from ..functions.schema import ENTRY, FIELDS


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of logs as they come; blank lines are skipped."""
    lines = spark.readStream.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", ENTRY).alias("e")).select(*(F.col(f"e.{c}").alias(c) for c in FIELDS))


def append_to(stream: DataFrame, table: str, checkpoint: str, every: str | None = None):
    """Appends a stream to a folder of Parquet files, each entry once; returns the writer, to be started. It looks for new
    entries all the time, each `every` ("1 second"), or once for all that is there ("now")."""
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return timed(writer, every)


def timed(writer, every: str | None):
    if every is None:
        return writer
    return writer.trigger(availableNow=True) if every == "now" else writer.trigger(processingTime=every)


def refreshed(estimates: DataFrame, decide: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Writer of live_estimates that calls decide(estimates that changed, number of the batch) after each refresh, so that
    a placement follows every completion."""
    return timed(estimates.writeStream.outputMode("update").foreachBatch(decide).option("checkpointLocation", checkpoint), every)


def refresh(mark: float | None, tasks: dict, rows: list[tuple]) -> tuple[float | None, dict, set]:
    """State of one host after a batch of (task, ms, value): only what is later than the mark counts, ties and late rows
    are dropped for good; the mark rises once the batch is through. A task's state is n, sum and sum of squares of the
    steps, and the last measurement."""
    changed = set()
    new = sorted((r for r in rows if mark is None or r[1] > mark), key=lambda r: (r[1], r[0]))
    for task, ms, value in new:
        n, total, squares, last, at, seen = tasks.get(task, (0, 0.0, 0.0, None, None, 0))
        if last is not None and ms > at:
            step = (value - last) / (ms - at) ** 0.5
            n, total, squares = n + 1, total + step, squares + step * step
        tasks[task] = (n, total, squares, value, ms, seen + 1)
        changed.add(task)
    return max([r[1] for r in new], default=mark), tasks, changed


def quantile(state: tuple, now: float, alpha: float) -> float:
    n, total, squares, last, at, _ = state
    if alpha == 0.5:
        return max(last, MIN_NORMAL)
    if n < 2:
        return 0.0
    spread = max(0.0, (squares - total * total / n) / (n - 1)) * (now - at)
    return max(0.0, last + normal_quantile(alpha) * spread**0.5 if spread > 0 else last)


def live_estimates(stream: DataFrame, alpha: float, horizon: float) -> DataFrame:
    """(host, task, last_ms, measurements, estimate) of tasks that a batch has changed, from a stream (host string, task
    string, ms double, real_time double). The estimate is for `horizon` ms after the last measurement. Marks are kept
    for each host, which a watermark over the whole stream can't do."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, tasks = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
        rows = [r for f in frames for r in zip(f["task"], f["ms"], f["real_time"])]
        mark, tasks, changed = refresh(mark, tasks, rows)
        if mark is not None:
            state.update((mark, json.dumps(tasks)))
        yield pd.DataFrame([(key[0], t, tasks[t][4], tasks[t][5], quantile(tuple(tasks[t]), tasks[t][4] + horizon, alpha)) for t in sorted(changed)], columns=["host", "task", "last_ms", "measurements", "estimate"])

    return stream.groupBy("host").applyInPandasWithState(update, "host string, task string, last_ms double, measurements long, estimate double", "mark double, tasks string", "update", GroupStateTimeout.NoTimeout)
