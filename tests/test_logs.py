"""The worked log through sources, ingest, statistics and the provenance interface."""

import json

import pytest
from . import worked

from tracewell.plans import ingest, logstats, provenance
from tracewell.sources import logs, replay


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = worked.write(tmp_path_factory.mktemp("log") / "r1.log", worked.LOG)
    return logs.read_log(spark, path).persist()


def test_cleaning(entries):
    kept = {r.line_no for r in logstats.cleaned(entries).collect()}
    assert kept == set(range(1, 28)) - {19, 9, 10}


def test_matching(entries):
    rows = logstats.expanded(logstats.cleaned(entries)).collect()
    by_line = {r.line_no: r.invoc_id for r in rows}
    assert [by_line[i] for i in (4, 5, 6, 7, 8, 11, 20)] == [1, 2, None, 1, 2, 1, 2]


def test_phases(entries):
    rows = {r.invoc_id: r for r in logstats.invocations(logstats.expanded(logstats.cleaned(entries))).collect()}
    assert [rows[1][p] for p in logstats.PHASES] == [5, 45, 20, 900, 30, 70]
    assert [rows[2][p] for p in logstats.PHASES] == [6, 54, 25, 1500, 50, 150]
    assert (rows[1].file_size, rows[2].file_size) == (30.0, 10.0)
    assert (rows[1].host, rows[2].host) == ("h1", "h2")


def test_statistics(entries):
    (r,) = logstats.statistics(entries).collect()
    assert [r[p] for p in logstats.PHASES] == [5, 49, 22, 1200, 40, 110]
    assert (r.max_concurrent, r.no_task_ready, r.idle, r.runtime, r.invocations) == (2, 1110, 864, 1700, 2)


def test_reports(entries):
    (r,) = logstats.report(entries).collect()
    assert (r.task_name, r.exec) == ("A", 1200)
    (w,) = logstats.wide_report(entries, ["A"]).collect()
    assert w["A_exec"] == 1200


def test_empty_log_has_no_statistics(spark):
    from pyspark.sql import types as T

    from tracewell.functions.schema import ENTRY

    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("line_no", T.LongType()), *ENTRY.fields])
    assert logstats.statistics(spark.createDataFrame([], schema)).collect() == []


def test_any_engine_name_and_blank_lines(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("\n" + json.dumps(worked.event(1, "container-requested", engine="other-event")) + "\n\n  \n")
    rows = logs.read_log(spark, str(p))
    assert ingest.events(rows).collect()[0].type == "container-requested"
    assert rows.count() == 1


def test_ingest(entries):
    (run,) = ingest.runs(entries).collect()
    assert (run.wf_name, run.wf_time, run.task_ids) == ("demo", 1700, [66])
    first = {r.invoc_id: r for r in ingest.invocations(entries).collect()}
    assert (first[1].timestamp, first[1].real_time, first[1].host, first[1].schedule_time) == (1010, 900, "h1", 5)
    assert {r.invoc_id: r.timestamp for r in ingest.invocations(entries, "last").collect()} == {1: 2001, 2: 2601}
    assert {r.invoc_id: r.timestamp for r in ingest.invocations(entries, "time").collect()} == {1: 2001, 2: 2601}
    assert {(r.invoc_id, r.file): r["size"] for r in ingest.files(entries).collect()} == {(1, "a.txt"): 10, (1, "b.txt"): 3, (2, "a.txt"): 10}
    assert ingest.events(entries, latest=True).count() == 3
    assert [tuple(r) for r in ingest.tasks(entries).collect()] == [(66, "A", "bash")]


def test_unreadable_run_time_is_one(spark, tmp_path):
    log = [worked.entry(1, 1, "invoc-time", {"realTime": "x"}), worked.entry(2, 1, "invoc-time-sched", {"realTime": "x"})]
    (r,) = ingest.invocations(logs.read_log(spark, worked.write(tmp_path / "y.log", log))).collect()
    assert (r.real_time, r.schedule_time) == (1, None)


def test_provenance(entries):
    store = provenance.Store(ingest.invocations(entries), ingest.runs(entries), ingest.tasks(entries), ingest.files(entries))
    assert {r.host for r in store.host_names().collect()} == {"h1", "h2"}
    assert [r.task_id for r in store.task_ids_for_workflow("demo").collect()] == [66]
    assert store.task_ids_for_workflow("other").collect() == [] and store.entries_for_tasks([]).collect() == []
    assert store.task_name(66).first().task_name == "A" and store.task_name(1).first() is None
    assert store.entries_on_host_since(66, "h1", 1010).count() == 0
    assert store.entries_on_host_since(66, "h1", 1010, inclusive=True).count() == 1
    assert store.timed("hosts", store.host_names, "demo").count() == 2 and store.access[0].rows == 2
    store.timed("hosts", store.host_names, "NOAT-demo")
    assert len(store.access) == 1


def test_nested_files(spark):
    inv = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, invoc_id long")
    files = spark.createDataFrame([("r", 1, "a", 5, 7, None), ("r", 1, "b", 6, 8, 9)], "run_id string, invoc_id long, file string, size long, real_time_in long, real_time_out long")
    rows = {r.invoc_id: r for r in provenance.with_files(inv, files).collect()}
    assert set(rows[1].input) == {"a", "b"} and rows[1].output["b"].real_time == 9 and rows[2].input == {}


def test_replay(spark, tmp_path):
    log = [
        worked.entry(1, 1, "invoc-script", "run a"), worked.entry(2, 1, "file-size-stageout", "1", "f"), worked.entry(3, 2, "file-size-stagein", "1", "f"),
        worked.entry(4, 2, "file-size-stageout", "1", "f"), worked.entry(5, 3, "file-size-stagein", "1", "f"), worked.entry(6, None, "wf-output", "f, g"),
    ]
    nodes, edges, outputs = replay.replayed(logs.read_log(spark, worked.write(tmp_path / "z.log", log)))
    assert {r.id: r.command for r in nodes.collect()}[1] == "run a"
    assert {(r.a, r.b) for r in edges.collect()} == {(2, 3)}
    assert {r.file for r in outputs.collect()} == {"f", "g"}


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 100, "b": 2048}')
    assert {tuple(r) for r in logs.read_memory(spark, str(tmp_path / "m.json")).collect()} == {("a", 100), ("b", 2048)}
    (tmp_path / "c.ini").write_text("# c\nx = 1\n[s]\ny=a=b\n")
    assert {tuple(r) for r in logs.read_ini(spark, str(tmp_path / "c.ini")).collect()} == {("x", "1"), ("y", "a=b")}
    (tmp_path / "t.loc").write_text("#v\tn\nhg19\tHuman\n")
    assert [tuple(r) for r in logs.read_data_table(spark, str(tmp_path / "t.loc"), ["value", "name"], "#").collect()] == [("hg19", "Human")]
    assert logs.read_data_table(spark, str(tmp_path / "t.loc"), ["value", "name"]).count() == 2
    (tmp_path / "1_data").write_text("2\na\nb,c7\n1\no\n")
    got = {(r.path, r.container, r.is_output) for r in logs.read_manifest(spark, str(tmp_path / "1_data")).collect()}
    assert got == {("a", None, False), ("b", "c7", False), ("o", None, True)}


def test_sinks(spark, entries, tmp_path):
    logs.append_log(entries, str(tmp_path / "log"))
    logs.append_log(entries, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2 * entries.count()
    logs.write_normalised(logstats.cleaned(entries), str(tmp_path / "n"))
    assert logs.read_report(spark, str(tmp_path / "n")).count() == 24
    logs.write_tsv(logstats.report(entries).drop("source"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["task_name"] == "A"


def test_paths(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([("a", "c1"), ("b", None), ("c", None)], "file string, container string")
    present = spark.createDataFrame([("/base/b",)], "path string")
    got = {r.file: r.path for r in logs.resolved(files, "/k", "/base", "/app", present).collect()}
    assert got == {"a": "/k/c1/a", "b": "/base/b", "c": "/app/c"}
    paths = spark.createDataFrame([("w.xml",), ("w.ga",), ("wxml",), ("x.y.LOG",)], "p string")
    assert [r[0] for r in paths.select(logs.language(F.col("p"))).collect()] == ["dax", "galaxy", None, "log"]


def test_amplified(spark):
    runs = spark.createDataFrame([("a" * 40,)], "run_id string")
    assert {r.run_id for r in logs.amplified(runs, 2, 100).collect()} == {"a" * 36 + "_100", "a" * 36 + "_101"}


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("x\r\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = logs.read_lines(spark, str(tmp_path / "*.log"))
            rows = {(r.source.rsplit("/", 1)[1], r.line_no): r.line for r in got.collect()}
            assert rows == {("a.log", i): x for i, x in enumerate(lines, 1)} | {("b.log", 1): "x", ("b.log", 2): "y"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("name", ["log_cleaned", "log_in_time_order", "log_invocations", "log_matches", "log_report", "log_wide_report", "log_statistics"])
def test_a_log_is_dealt_out_once_and_not_stored(spark, sf, name, monkeypatch):
    from tracewell import storage
    from tracewell.plans import log_queries
    from tracewell.plans.queries import QUERIES

    monkeypatch.setattr(storage, "scratch", None)
    monkeypatch.setattr(log_queries, "DEALT", 1000)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange rangepartitioning" in plan
