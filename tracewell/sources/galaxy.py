"""Workflows of a tool-based workbench (.ga JSON), its tool descriptions and reference tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

ACTION = "struct<action_type:string,output_name:string,action_arguments:map<string,string>>"
STEP = f"struct<id:bigint,type:string,inputs:array<struct<name:string>>,tool_id:string,tool_version:string,tool_state:string,input_connections:map<string,struct<id:bigint,output_name:string>>,outputs:array<struct<name:string>>,post_job_actions:map<string,{ACTION}>>"
TOOL = "tool_id string, version string, template string, requirements array<struct<name:string,version:string>>, outputs array<struct<name:string,format:string,from_work_dir:string>>, tables array<struct<param:string,table:string>>"


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """One row for each step of each workflow file: run and the step's fields; tool ids lose their repository."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.from_json("value", f"struct<steps:map<string,{STEP}>>").alias("w"))
    steps = files.select("run", F.explode("w.steps").alias("key", "s")).select("run", "s.*")
    return steps.withColumn("tool_id", scalar.tool_name(F.col("tool_id"))).withColumn("tool_state", scalar.repair_tool_state(F.col("tool_state")))


def expand_macros(xml: str, macros: dict[str, str]) -> str:
    """Every <expand macro="..."/> becomes the macro's text; in one with a body the body takes the place of <yield/>."""

    def inserted(m: re.Match) -> str:
        text = macros.get(m.group(1))
        return m.group(0) if text is None else text.replace("<yield/>", (m.group(2) or "").strip())

    return re.sub(r'<expand macro="([^"]*)"\s*(?:/>|>(.*?)</expand>)', inserted, xml, flags=re.DOTALL)


def macros_of(xml: str) -> dict[str, str]:
    """Macros by name: the text between their tags. Of equal names the last wins."""
    return {m.group(1): m.group(2).strip() for m in re.finditer(r'<(?:macro|xml)\s[^>]*name="([^"]*)"[^>]*>(.*?)</(?:macro|xml)>', xml, flags=re.DOTALL)}


def parse_tool(xml: str, folder: str = "", shared: dict[str, str] | None = None) -> tuple | None:
    """A tool description as a row (TOOL); none without a command."""
    root = ElementTree.fromstring(expand_macros(xml, (shared or {}) | macros_of(xml)))
    command = root.find(".//command")
    if root.tag != "tool" or command is None:
        return None
    for m in root.findall("macros"):
        root.remove(m)
    template = (command.text or "").strip()
    if command.get("interpreter"):
        script = template.split(" ")[0]
        template = f"{command.get('interpreter')} {template.replace(script, f'{folder}/{script}')}"
    template = re.sub(r"\.(value|dataset)\b", "", template)
    requirements = [{"name": (e.text or "").strip(), "version": e.get("version", "")} for e in root.iter("requirement")]
    outputs = []
    for e in root.iterfind("outputs//data"):
        own, source = e.get("format", ""), e.get("metadata_source", "")
        outputs.append({"name": e.get("name"), "format": source if own == "input" and source else own, "from_work_dir": e.get("from_work_dir", "")})
        template = re.sub(rf"\$({{?){re.escape(e.get('name', ''))}(}}?)(?![\w.])", lambda m, n=e.get("name", ""): f"${m.group(1)}{n}.path{m.group(2)}", template)
    tables = [{"param": p.get("name"), "table": o.get("from_data_table")} for p in root.iter("param") for o in [*p.iterfind("option"), *p.iterfind("options")] if o.get("from_data_table")]
    return root.get("id"), root.get("version", "1.0.0"), template, requirements, outputs, tables


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """Tool descriptions (TOOL); of equal ids and versions each file has its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, x in zip(f["path"], f["value"]) if (r := parse_tool(x, p.rsplit("/", 1)[0]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("tool_id", "version", "template", "requirements", "outputs", "tables")])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, TOOL)


def read_table_config(spark: SparkSession, path: str) -> DataFrame:
    """(table, comment, columns, file) of a data-table configuration."""
    rows = spark.read.format("xml").option("rowTag", "table").schema("_name string, _comment_char string, columns string, file struct<_path:string>").load(path)
    return rows.select(F.col("_name").alias("table"), F.coalesce("_comment_char", F.lit("")).alias("comment"), F.split(F.trim("columns"), r"\s*,\s*").alias("columns"), F.col("file._path").alias("file"))


def read_data_types(spark: SparkSession, path: str) -> DataFrame:
    """(extension, module, name) of data types that have an extension and a type and are no subclass; the type is module:name."""
    rows = spark.read.format("xml").option("rowTag", "datatype").schema("_extension string, _type string, _subclass string").load(path)
    kept = rows.filter("_extension is not null and _type is not null and _subclass is null")
    parts = F.split("_type", ":")
    return kept.select(F.col("_extension").alias("extension"), parts[0].alias("module"), F.try_element_at(parts, F.lit(2)).alias("name"))


def read_tool_list(spark: SparkSession, path: str, default_dir: str = "") -> DataFrame:
    """(file, dir, repository, owner, revision) of a tool library's configuration: the folder is its tool_path, else the
    default one; what a tool doesn't name is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["value"]:
                root = ElementTree.fromstring(text)
                for tool in root.iter("tool"):
                    of = [(tool.findtext(f".//{k}") or "").strip() for k in ("repository_name", "repository_owner", "installed_changeset_revision")]
                    if tool.get("file"):
                        rows.append((tool.get("file"), root.get("tool_path", default_dir), *of))
            yield pd.DataFrame(rows, columns=["file", "dir", "repository", "owner", "revision"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "file string, dir string, repository string, owner string, revision string")


def environments(listed: DataFrame, tools: DataFrame, dependency_dir: str, lines: DataFrame) -> DataFrame:
    """(tool_id, line_no, line) of the env.sh files of tools' requirements, for tools (TOOL and file) whose repository,
    owner and revision are listed; lines (path, line_no, line) are those of all env.sh files there are."""
    named = listed.filter("repository <> '' and owner <> '' and revision <> ''")
    needs = tools.select("tool_id", "file", F.explode("requirements").alias("r")).join(named, "file")
    path = F.concat_ws("/", F.lit(dependency_dir), "r.name", "r.version", "owner", "repository", "revision", F.lit("env.sh"))
    return needs.withColumn("path", path).join(lines, "path").select("tool_id", "line_no", "line")


def workflow(steps: DataFrame, tools: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes (run, id, name, template), edges (run, a, b), io (run, id, param, file, direction, is_output), missing
    (run, id, tool_id, tool_version): steps whose tool isn't known.

    An output's type is its declared one, else the type of the input that it names, else that of the first input; the
    file is <step>_<output>.<extension>, or its new name. Outputs that aren't hidden are the workflow's.
    """
    tool_steps = steps.filter("type = 'tool'")
    same = [tool_steps["tool_id"] == tools["tool_id"], tool_steps["tool_version"] == tools["version"]]
    missing = tool_steps.join(tools, same, "left_anti").select("run", "id", "tool_id", "tool_version")
    known = tool_steps.join(tools.select(F.col("tool_id").alias("_tool"), F.col("version").alias("_version"), "template", F.col("outputs").alias("declared")), [tool_steps["tool_id"] == F.col("_tool"), tool_steps["tool_version"] == F.col("_version")])
    nodes = known.select("run", "id", F.col("tool_id").alias("name"), "template")
    links = tool_steps.select("run", "id", F.explode("input_connections").alias("param", "c")).select("run", "id", "param", F.col("c.id").alias("a"), F.col("c.output_name").alias("output"))
    edges = links.join(tool_steps.select("run", F.col("id").alias("a")), ["run", "a"], "left_semi").select("run", "a", F.col("id").alias("b")).distinct()

    given = steps.filter("type = 'data_input'").select("run", "id", F.explode("inputs.name").alias("file")).withColumn("extension", scalar.first_extension(F.col("file")))
    extensions = types.select("extension").distinct()
    given = given.join(extensions.withColumn("_known", F.lit(True)), "extension", "left").select("run", "id", F.lit("output").alias("output"), "file", F.when(F.col("_known"), F.col("extension")).alias("type"))

    actions = tool_steps.select("run", "id", F.explode("post_job_actions").alias("_k", "p")).select("run", "id", F.col("p.output_name").alias("output"), "p.action_type", F.col("p.action_arguments")["newname"].alias("newname"))
    renames = actions.filter("action_type = 'RenameDatasetAction' and newname is not null").groupBy("run", "id", "output").agg(scalar.underscored(F.max("newname")).alias("renamed"))
    hidden = actions.filter("action_type = 'HideDatasetAction'").select("run", "id", "output").distinct().withColumn("hidden", F.lit(True))
    formats = known.select("run", "id", F.explode("declared").alias("d")).select("run", "id", F.col("d.name").alias("output"), F.col("d.format").alias("format"))
    made = known.select("run", "id", F.explode("outputs.name").alias("output")).join(formats, ["run", "id", "output"], "left")
    made = made.join(extensions.withColumnRenamed("extension", "format").withColumn("_own", F.lit(True)), "format", "left")
    first = links.groupBy("run", "id").agg(F.min("param").alias("_first"))
    made = made.join(first, ["run", "id"], "left").withColumn("_from", F.when(F.col("format") == "input", F.col("_first")).otherwise(F.col("format")))
    sources = links.select("run", "id", F.col("param").alias("_from"), F.col("a").alias("_a"), F.col("output").alias("_o"))
    made = made.join(sources, ["run", "id", "_from"], "left")
    # types that are passed on are looked up among the given inputs; a tool's own declared type ends the search
    passed = given.select("run", F.col("id").alias("_a"), F.col("output").alias("_o"), F.col("type").alias("_given"))
    own = made.filter("_own").select("run", F.col("id").alias("_a"), F.col("output").alias("_o"), F.col("format").alias("_made"))
    made = made.join(passed, ["run", "_a", "_o"], "left").join(own, ["run", "_a", "_o"], "left")
    made = made.withColumn("type", F.when(F.col("_own"), F.col("format")).otherwise(F.coalesce("_given", "_made")))
    made = made.join(renames, ["run", "id", "output"], "left").join(hidden, ["run", "id", "output"], "left")
    plain = F.concat(F.col("id").cast("string"), F.lit("_"), "output", F.when(F.col("type").isNotNull(), F.concat(F.lit("."), "type")).otherwise(""))
    made = made.select("run", "id", "output", F.coalesce("renamed", plain).alias("file"), F.col("hidden").isNull().alias("is_output"))
    files = given.select("run", F.col("id").alias("a"), "output", "file").unionByName(made.select("run", F.col("id").alias("a"), "output", "file"))
    inputs = links.join(files, ["run", "a", "output"]).select("run", "id", "param", "file", F.lit("input").alias("direction"), F.lit(False).alias("is_output"))
    return nodes, edges, inputs.unionByName(made.select("run", "id", F.col("output").alias("param"), "file", F.lit("output").alias("direction"), "is_output")), missing
