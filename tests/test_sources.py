"""Workflow descriptions and live logs."""

import json

import pytest
from . import worked

from tracewell.operators.estimate import wiener_estimates
from tracewell.sources import dax, galaxy
from tracewell.streaming import live

DAX = """<adag xmlns="http://pegasus.isi.edu/schema/DAX">
<job id="ID1" name="split"><argument>-i <file name="in.txt"/>
  -o <filename file="mid.txt"/></argument><uses file="in.txt" link="input" size="5"/><uses file="mid.txt" link="output" size="7"/><uses file="split" link="input" type="executable"/></job>
<job id="ID2" name="join" runtime="3"><uses file="mid.txt" link="input"/><uses file="in.txt" link="input"/><uses file="out.txt" link="output" size="9"/><uses file="mid.txt" link="output"/></job>
<child ref="ID2"><parent ref="ID1"/></child></adag>"""


def test_dax(spark, tmp_path):
    (tmp_path / "w.dax").write_text(DAX)
    nodes, edges, io = dax.read(spark, str(tmp_path / "w.dax"))
    command = {r.id: r.command for r in nodes.collect()}
    assert command["ID1"] == "split -i in.txt -o mid.txt"
    assert command["ID2"] == "sleep 3.0\ndd if=/dev/zero of=out.txt bs=9 count=1"
    assert [(r.a, r.b) for r in edges.collect()] == [("ID1", "ID2")]
    got = {(r.id, r.file, r.direction): r.is_output for r in io.collect()}
    assert got == {("ID1", "in.txt", "input"): False, ("ID1", "mid.txt", "output"): False, ("ID2", "mid.txt", "input"): False, ("ID2", "in.txt", "input"): False, ("ID2", "out.txt", "output"): True}
    assert {(r.id, r.file) for r in dax.needed_inputs(nodes, io).collect()} == {("ID1", "in.txt"), ("ID2", "mid.txt")}


TOOL = """<tool id="cut" version="2"><macros><xml name="req"><requirement version="1.0">samtools</requirement><yield/></xml></macros>
<expand macro="req"><requirement>awk</requirement></expand>
<command interpreter="python">cut.py $input.value $out</command>
<inputs><param name="ref" type="select"><options from_data_table="genomes"/></param></inputs>
<outputs><data name="out" format="input" metadata_source="input" from_work_dir="o.bed"/><data name="log" format="txt"/></outputs></tool>"""


def test_tool():
    tool_id, version, template, requirements, outputs, tables = galaxy.parse_tool(TOOL, "/tools")
    assert (tool_id, version) == ("cut", "2")
    assert template == "python /tools/cut.py $input $out.path"
    assert [r["name"] for r in requirements] == ["samtools", "awk"]
    assert [(o["name"], o["format"]) for o in outputs] == [("out", "input"), ("log", "txt")]
    assert tables == [{"param": "ref", "table": "genomes"}]
    assert galaxy.parse_tool("<tool id='x'/>") is None


def test_workflow(spark, tmp_path):
    steps = {
        "0": {"id": 0, "type": "data_input", "inputs": [{"name": "reads.bed"}], "input_connections": {}, "outputs": []},
        "1": {"id": 1, "type": "tool", "tool_id": "repo/x/cut/2", "tool_version": "2", "tool_state": '{"a": "1"}', "input_connections": {"input": {"id": 0, "output_name": "output"}}, "outputs": [{"name": "out"}, {"name": "log"}],
              "post_job_actions": {"h": {"action_type": "HideDatasetAction", "output_name": "log"}, "r": {"action_type": "RenameDatasetAction", "output_name": "log", "action_arguments": {"newname": "my log"}}}},
        "2": {"id": 2, "type": "tool", "tool_id": "unknown", "tool_version": "1", "tool_state": "{}", "input_connections": {"input": {"id": 1, "output_name": "out"}}, "outputs": []},
    }
    (tmp_path / "w.ga").write_text(json.dumps({"steps": steps}))
    (tmp_path / "t.xml").write_text(TOOL)
    (tmp_path / "types.xml").write_text('<datatypes><registration><datatype extension="bed" type="mod:Bed"/><datatype extension="txt" type="mod:Txt"/><datatype extension="x" type="m:X" subclass="True"/></registration></datatypes>')
    types = galaxy.read_data_types(spark, str(tmp_path / "types.xml"))
    assert {tuple(r) for r in types.collect()} == {("bed", "mod", "Bed"), ("txt", "mod", "Txt")}
    nodes, edges, io, missing = galaxy.workflow(galaxy.read_steps(spark, str(tmp_path / "w.ga")), galaxy.read_tools(spark, str(tmp_path / "t.xml")), types)
    assert [(r.id, r.name) for r in nodes.collect()] == [(1, "cut")]
    assert [r.tool_id for r in missing.collect()] == ["unknown"]
    assert [(r.a, r.b) for r in edges.collect()] == [(1, 2)]
    assert {(r.id, r.direction, r.file, r.is_output) for r in io.collect()} == {(1, "input", "reads.bed", False), (2, "input", "1_out.bed", False), (1, "output", "1_out.bed", True), (1, "output", "my_log", False)}


def test_tool_configurations(spark, tmp_path):
    (tmp_path / "tables.xml").write_text('<tables><table name="genomes" comment_char="#"><columns>value, name</columns><file path="g.loc"/></table></tables>')
    (r,) = galaxy.read_table_config(spark, str(tmp_path / "tables.xml")).collect()
    assert (r.table, r.comment, r["columns"], r.file) == ("genomes", "#", ["value", "name"], "g.loc")
    (tmp_path / "tools.xml").write_text('<toolbox><section><tool file="a.xml"/></section></toolbox>')
    assert [r.file for r in galaxy.read_tool_list(spark, str(tmp_path / "tools.xml")).collect()] == ["a.xml"]


def test_live_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    worked.write(tmp_path / "in" / "a.log")
    live.append_to(live.read_live(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 27


ROWS = [("a", "x", 0.0, 10.0), ("a", "x", 100.0, 14.0), ("a", "x", 400.0, 11.0), ("a", "x", 900.0, 20.0), ("b", "x", 5.0, 1.0)]


def test_live_estimates_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame(ROWS, "host string, task string, ms double, real_time double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, task string, ms double, real_time double").parquet(str(tmp_path / "in"))
    got = live.live_estimates(stream, 0.2, 100.0)
    got.writeStream.format("memory").queryName("live_est").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = {(r.host, r.task): r.estimate for r in spark.table("live_est").collect()}
    from pyspark.sql import functions as F

    batch = wiener_estimates(spark.createDataFrame(ROWS, "host string, task string, ms double, real_time double"), 0.2, F.col("last_ms") + 100, ["host", "task"], ["ms"])
    assert rows == pytest.approx({(r.host, r.task): r.estimate for r in batch.collect()})


def test_marks_drop_late_and_tied_rows():
    mark, tasks, _ = live.refresh(None, {}, [("x", 10.0, 1.0)])
    mark, tasks, changed = live.refresh(mark, tasks, [("x", 10.0, 9.0), ("y", 3.0, 9.0)])
    assert mark == 10.0 and changed == set() and set(tasks) == {"x"}
