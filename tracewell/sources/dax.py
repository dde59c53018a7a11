"""Abstract workflows in DAX XML, as graph tables.

A file is one workflow and fits a worker; arguments mix text and elements in order, which a row reader would lose, so
each file is parsed as a whole, files side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, id string, name string, command string, runtime double, file string, direction string, size long, parent string"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _words(text: str | None) -> str:
    return " ".join((text or "").split())


def parse(xml: str) -> list[tuple]:
    """Rows (SCHEMA) of nodes, of their files, and of edges."""
    root = ElementTree.fromstring(xml)
    rows: list[tuple] = []
    for job in (e for e in root.iter() if _tag(e) == "job"):
        parts = []
        for argument in (e for e in job.iter() if _tag(e) == "argument"):
            parts.append(_words(argument.text))
            for e in argument:
                parts.append(e.get("name", "") if _tag(e) == "file" else e.get("file", "") if _tag(e) == "filename" else "")
                parts.append(_words(e.tail))
        command = " ".join([job.get("name", ""), *filter(None, parts)])
        rows.append(("node", job.get("id"), job.get("name"), command, float(job.get("runtime", 0)), None, None, None, None))
        inputs = set()
        for uses in (e for e in job.iter() if _tag(e) == "uses" and e.get("type") != "executable"):
            file, link = uses.get("file"), uses.get("link")
            inputs |= {file} if link == "input" else set()
            if link == "input" or (link == "output" and file not in inputs):
                rows.append(("io", job.get("id"), None, None, None, file, link, int(uses.get("size", 0)), None))
    for child in (e for e in root.iter() if _tag(e) == "child"):
        rows += [("edge", child.get("ref"), None, None, None, None, None, None, p.get("ref")) for p in child.iter() if _tag(p) == "parent"]
    return rows


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (run, id, name, command, runtime, cost), edges (run, a, b), io (run, id, file, direction, size, is_output).

    An output that is also an input of the same job is an input only. Outputs of jobs without children are the
    workflow's. A job with a run time is a synthetic one: it sleeps and writes its outputs in their sizes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, text in zip(f["run"], f["value"]):
                rows = parse(text)
                yield pd.DataFrame([(name, *r) for r in rows], columns=["run", *(c.split()[0] for c in SCHEMA.split(", "))]).astype({"size": "Int64"})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), "value")
    rows = files.mapInPandas(run, f"run string, {SCHEMA}")
    edges = rows.filter("kind = 'edge'").select("run", F.col("parent").alias("a"), F.col("id").alias("b")).distinct()
    io = rows.filter("kind = 'io'").select("run", "id", "file", "direction", "size")
    parents = edges.select("run", F.col("a").alias("id")).distinct().withColumn("_p", F.lit(True))
    io = io.join(parents, ["run", "id"], "left").withColumn("is_output", (F.col("direction") == "output") & F.col("_p").isNull()).drop("_p")
    nodes = rows.filter("kind = 'node'").select("run", "id", "name", "command", "runtime", F.col("runtime").alias("cost"))
    return with_synthetic(nodes, io), edges, io


def with_synthetic(nodes: DataFrame, io: DataFrame) -> DataFrame:
    """Commands of jobs with a run time: sleep that long, then write each output."""
    writes = io.filter("direction = 'output'").groupBy("run", "id").agg(
        F.array_sort(F.collect_list(F.concat(F.lit("dd if=/dev/zero of="), "file", F.lit(" bs="), F.col("size").cast("string"), F.lit(" count=1")))).alias("_w")
    )
    script = F.concat(F.lit("sleep "), F.col("runtime").cast("string"), F.lit("\n"), F.coalesce(F.array_join("_w", "\n"), F.lit("")))
    return nodes.join(writes, ["run", "id"], "left").withColumn("command", F.when(F.col("runtime") > 0, script).otherwise(F.col("command"))).drop("_w")


def needed_inputs(nodes: DataFrame, io: DataFrame) -> DataFrame:
    """Inputs that must be there: all of them, but for synthetic jobs only those that other jobs produce."""
    made = io.filter("direction = 'output'").select("run", "file").distinct().withColumn("_made", F.lit(True))
    rows = io.filter("direction = 'input'").join(nodes.select("run", "id", "runtime"), ["run", "id"]).join(made, ["run", "file"], "left")
    return rows.filter("runtime <= 0 or _made").select("run", "id", "file", "size")
