"""Languages, policies, stores, black-box tasks and the counts around them."""

import pytest
from . import worked
from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.plans import plugins
from tracewell.sources import logs, stores


def test_languages(spark, tmp_path):
    (tmp_path / "w.dax").write_text('<adag><job id="a" name="x"/></adag>')
    assert plugins.read_workflow(spark, str(tmp_path / "w.dax"))[0].count() == 1
    nodes, _, _ = plugins.read_workflow(spark, worked.write(tmp_path / "r.log"))
    assert {r.id for r in nodes.collect()} == {1, 2}
    with pytest.raises(ValueError, match="endings"):
        plugins.read_workflow(spark, "a.foo")


def test_policies():
    assert plugins.policy("dataAware") is plugins.policy("ERA")
    plugins.register_policy("own", len)
    assert plugins.policy("own") is len
    with pytest.raises(ValueError, match="unknown"):
        plugins.policy("other")


def test_stores(spark, tmp_path):
    entries = logs.read_log(spark, worked.write(tmp_path / "r.log"))
    (run,) = stores.run_documents(entries).collect()
    assert set(run.events) == {"container-requested", "container-allocated", "container-completed"} and run.wf_name == "demo"
    docs = {r.invoc_id: r for r in stores.invocation_documents(entries).collect()}
    assert docs[1].timestamp == 2001
    store = stores.in_memory(entries)
    assert isinstance(store.host_names().count(), int) and store.entries_on_host_since(66, "h1", 2000).count() == 1


def test_commands(spark):
    tasks = spark.createDataFrame([("a", "echo hi"), ("b", "exit 3")], "id string, command string")
    with pytest.raises(PermissionError):
        plugins.run_commands(tasks)
    got = {r.id: r for r in plugins.run_commands(tasks, allow=True).collect()}
    assert (got["a"].exit_code, got["a"].stdout, got["a"].tries) == (0, "hi\n", 1)
    assert (got["b"].exit_code, got["b"].tries) == (3, 2)


def test_counts(spark):
    tasks = spark.createDataFrame([("r", s) for s in ("ready", "ready", "running", "finished", "waiting")], "run string, state string")
    r = plugins.totals(tasks, ["run"]).first()
    assert (r.ready, r.running, r.finished, r.total) == (2, 1, 1, 5)
    assert not plugins.is_done(tasks, ["run"]).first().done and plugins.is_done(tasks.filter("state = 'finished'"), ["run"]).first().done


def test_input_bytes(spark):
    files = spark.createDataFrame([("t", "a", 5), ("t", "b", 7)], "task string, file string, size long")
    there = spark.createDataFrame([("b", "h")], "file string, host string")
    assert [tuple(r) for r in plugins.input_bytes(files, there, ["task"]).collect()] == [("t", 12, "h", 7)]


def test_parameters(spark):
    assert plugins.mapped_values({"a": "x", "b": [None, "y", {"c": "x"}], "d": None}, {"x": 1}) == {"a": 1, "b": ["y", {"c": 1}]}
    tools = spark.createDataFrame([("t", [("p", "g")])], "tool_id string, tables array<struct<param:string,table:string>>")
    rows = spark.createDataFrame([("g", "hg19", "Human")], "table string, value string, content string")
    assert [tuple(r) for r in plugins.table_parameters(tools, rows).collect()] == [("t", "p", "hg19", "Human")]


def test_tool_state(spark):
    state = '{"a": "{\\"b\\": \\"null\\", \\"c\\": 1}", "d": ""x""}'
    fixed = spark.createDataFrame([(state,)], ["x"]).select(scalar.repair_tool_state(F.col("x"))).first()[0]
    import json

    assert json.loads(fixed) == {"a": {"b": "", "c": 1}, "d": "x"}


def test_arriving_nodes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("r", 1), ("r", 1), ("r", 2)], "run string, id long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = plugins.new_nodes(spark.readStream.schema("run string, id long").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("nodes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("nodes").count() == 2


def test_relational_store(spark):
    url, driver = "jdbc:derby:memory:prov;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    stores.write_jdbc(spark.createDataFrame([(i, f"h{i}") for i in range(10)], "ID long, HOST string"), url, "INVOCATION", driver=driver)
    got = stores.read_jdbc(spark, url, "INVOCATION", "ID", 0, 10, 3, driver=driver)
    assert got.rdd.getNumPartitions() == 3 and got.filter("ID > 6").count() == 3 and got.count() == 10
