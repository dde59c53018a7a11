"""The steps on Arrow batches against those on DataFrames, and by hand."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tests import worked
from tracewell.functions import schema as S
from tracewell.plans import log_batches, log_queries, logstats
from tracewell.sources import logs

SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("line_no", T.LongType()), *S.ENTRY.fields])
PHASES = logstats.PHASES


def odd_log(seed: int, runs: int = 40, most: int = 60) -> list[tuple]:
    """Entries that repeat, lack fields, hold values that can't be read and tell events without their counterparts."""
    r = random.Random(seed)
    keys = [S.EXEC, S.TIME, S.HOST, S.TIME_SCHED, S.TIME_STAGE_IN, S.TIME_STAGE_OUT, S.FILE_SIZE_IN, S.SCRIPT, S.EVENT, S.EVENT, S.EVENT, S.EVENT, "other-event", "Xy-event", None]
    values = [None, "x", "3", "2.5", "{", '{"realTime":"7"}', '{"realTime":8}', '{"realTime":" 9 "}', '{"realTime":"1.5"}', '{"realTime":null}', '{"realTime":"-4"}', '{"a":{"realTime":"5"}}', "[1]", "h1"]
    kinds, codes = [S.REQUESTED, S.ALLOCATED, S.COMPLETED, S.ALLOCATED, S.COMPLETED, "odd"], ["", ',"exit-code":0', ',"exit-code":-100', ',"exit-code":"1"', ',"exit-code":"x"', ',"exit-code":null']
    out = []
    for i in range(runs):
        lines = []
        for n in range(r.randrange(1, most)):
            if lines and r.random() < 0.2:
                lines.append((lines[-r.randrange(1, min(5, len(lines)) + 1)][0], lines[-1][1], *r.choice(lines)[2:]) if r.random() < 0.5 else r.choice(lines))
            else:
                key, invoc = r.choice(keys), r.choice([None, 0, 1, 2, 3])
                event = f'{{"type":"{r.choice(kinds)}"' + r.choice(["", *[f',"container-id":"c{c}"' for c in range(4)]]) + r.choice(codes) + "}"
                value = r.choice(values) if key is None or not key.endswith("event") or r.random() < 0.1 else event
                lines.append((r.choice([None, 5, 10, 10, 20, 30 + n]), "r", r.choice([None, 1, 2]), r.choice([None, "A", "B"]), r.choice([None, "bash"]), invoc, r.choice([None, "f"]), key, value))
        out += [(f"log{i:03}" if i else None, n, *x) for n, x in enumerate(lines, 1)]
    r.shuffle(out)
    return out


def as_rows(rows) -> list:
    return sorted(map(repr, (tuple(x.asDict().values()) if hasattr(x, "asDict") else tuple(x.values()) for x in rows)))


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_steps_on_dataframes(spark, seed):
    rows = spark.createDataFrame(odd_log(seed), SCHEMA).persist()
    t = rows.toArrow()
    kept = logstats.cleaned(rows)
    both = [kept.select("source", "line_no"), pa.table({c: log_batches.cleaned(t).told(c) for c in ("source", "line_no")})]
    matched = logstats.expanded(kept)
    pairs = [
        both, [matched.filter("type is not null").select("source", "line_no", "invoc_id", "task_name"), log_batches.matches(t)], [logstats.invocations(matched), log_batches.invocations(t)],
        [logstats.report(rows), log_batches.report(t)], [logstats.wide_report(rows, ["A", "C"]), log_batches.wide_report(t, ["A", "C"])],
    ]
    for want, got in pairs:
        assert got.column_names == want.columns
        assert as_rows(want.collect()) == as_rows(got.to_pylist())
    assert log_batches.invocations(t).num_rows > 50


def test_worked_log_by_runs(spark, tmp_path):
    """Also of entries that aren't dealt out by run, in batches smaller than a run."""
    path = worked.write(tmp_path / "r1.log", worked.LOG)
    worked.write(tmp_path / "r2.log", worked.LOG)
    entries = logs.read_log(spark, str(tmp_path / "*.log")).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = log_batches.by_runs(entries, log_batches.report, "source string, task_name string, invocations long, " + ", ".join(f"{p} long" for p in PHASES), rows=3).collect()
        first = log_batches.by_runs(entries, lambda t: log_batches.in_time_order(t, 2), "source string, line_no long", rows=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 2 and all(tuple(r)[1:] == ("A", 2, 5, 49, 22, 1200, 40, 110) for r in got) and path
    assert sorted(r.line_no for r in first) == [1, 1, 2, 2]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Entries that aren't equal stay, whatever their hashes."""
    rows = [("s", n, 1, "r", None, None, None, None, None, S.SCRIPT, v) for n, v in enumerate("abcab", 1)]
    t = pa.Table.from_pylist([dict(zip(SCHEMA.fieldNames(), r, strict=True)) for r in rows], pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in SCHEMA]))
    apart = log_batches.hashed
    for hashed in (apart, lambda fields: apart(fields) * 0):
        monkeypatch.setattr(log_batches, "hashed", hashed)
        assert log_batches.cleaned(t).told("line_no").to_pylist() == [1, 2, 3]


def test_the_log_is_that_of_entries(spark, sf):
    want = log_queries.entries(spark, sf).toArrow()
    got = log_queries.told(log_queries._numbered(spark, sf).toArrow())
    got = got.cast(want.schema) if got.schema != want.schema else got
    assert as_rows(want.to_pylist()) == as_rows(got.to_pylist())


@pytest.mark.parametrize("name", ["log_in_time_order", "log_invocations", "log_matches", "log_report", "log_wide_report"])
def test_entries_are_neither_sorted_nor_exchanged(spark, sf, name):
    """Lineitems are sorted once; the entries that they tell, 18 times as many, never are rows of Spark."""
    from tracewell.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort ") == 1 and "Generate" not in plan and plan.count("MapInArrow") == 1


def test_report_comes_in_order(spark, sf, monkeypatch):
    monkeypatch.setattr(log_queries, "DEALT", 1000)
    rows = [(r.source, r.task_name) for r in log_queries.log_report(spark, sf).collect()]
    assert rows == sorted(rows) and len(rows) > 1000


@pytest.mark.parametrize("seed", range(3, 5))
def test_statistics_equal_to_the_steps_on_dataframes(spark, seed):
    """Also of odd workflow names and times, runs without any time stamp, runs without invocations and larger times."""
    r, rows = random.Random(seed), odd_log(seed)
    for source in {x[0] for x in rows}:
        for n in range(r.randrange(4)):
            key, value = r.choice([(S.WF_NAME, "wf"), (S.WF_TIME, r.choice([None, "x", "7000", " 12 ", "1.5", "-3"]))])
            rows.append((source, 1000 + n, r.choice([None, 0, 7, 15, 1 << 42]), "r", None, None, None, None, None, key, value))
    rows += [("no times", n, None, "r", 1, "A", None, n % 2, None, k, '{"realTime":"5"}') for n, k in enumerate([S.EXEC, S.TIME, S.TIME_SCHED, S.TIME])]
    rows += [("no invocation", 1, 5, "r", None, None, None, None, None, S.WF_NAME, "wf"), ("no invocation", 2, 9, "r", None, None, None, None, None, S.WF_TIME, "4")]
    df = spark.createDataFrame(rows, SCHEMA)
    want, got = logstats.statistics(df), log_batches.statistics(df.toArrow())
    assert got.column_names == want.columns
    assert as_rows(want.collect()) == as_rows(got.to_pylist())
    assert got.num_rows > 30 and any(x["no_task_ready"] is None for x in got.to_pylist())
    # and of logs whose entries all are without an invocation, or go
    none = df.filter("source = 'no invocation'").toArrow()
    gone = pa.Table.from_pylist([dict(zip(SCHEMA.fieldNames(), ("s", 1, 1, "r", None, None, None, 1, None, S.EVENT, f'{{"type":"{S.COMPLETED}","exit-code":1}}'), strict=True))], none.schema)
    assert log_batches.statistics(none).num_rows == log_batches.statistics(gone).num_rows == 0


def test_statistics_of_a_log_are_not_rows_of_entries(spark, sf, monkeypatch):
    """As for the others above; and runs are dealt out and sorted by number."""
    from tracewell.plans.queries import QUERIES

    monkeypatch.setattr(log_queries, "DEALT", 1000)
    plan = QUERIES["log_statistics"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort ") == 1 and "Generate" not in plan and plan.count("MapInArrow") == 1
    assert "rangepartitioning(l_orderkey" in plan


def test_numbers_are_ordered_with_and_without_packing():
    for far in (7, 1 << 62):
        a, b = np.array([3, 1, 3, 1, 1]), np.array([0, far, -5, far, -far])
        assert log_batches.in_order(a, b).tolist() == [4, 1, 3, 2, 0]
    assert log_batches.in_order(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
