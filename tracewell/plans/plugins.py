"""Points of extension: workflow languages, placement policies, stores, and black-box tasks."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import suffix
from ..operators.schedule import POLICIES
from ..sources import dax, galaxy, logs, replay

#: (nodes, edges, files or outputs) of a workflow file.
Graph = tuple[DataFrame, DataFrame, DataFrame]


class Provenance(Protocol):
    """What a store of provenance answers."""

    def host_names(self) -> DataFrame: ...

    def task_ids_for_workflow(self, name: str) -> DataFrame: ...

    def task_name(self, task_id: int) -> DataFrame: ...

    def entries_for_tasks(self, ids) -> DataFrame: ...

    def entries_on_host_since(self, task_id: int, host, since: int, inclusive: bool = False) -> DataFrame: ...


_languages: dict[str, Callable[[SparkSession, str], Graph]] = {}


def register_language(ending: str, read: Callable[[SparkSession, str], Graph]) -> None:
    _languages[ending] = read


def register_policy(name: str, policy: Callable) -> None:
    POLICIES[name] = policy


def policy(name: str) -> Callable:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}; known are {', '.join(sorted(POLICIES))}")
    return POLICIES[name]


register_language("dax", dax.read)
register_language("xml", dax.read)
register_language("log", lambda spark, path: replay.replayed(logs.read_log(spark, path)))


def galaxy_language(spark: SparkSession, tools: str, types: str) -> None:
    """Workbench workflows need the tools and data types they are read with."""
    register_language("ga", lambda s, path: galaxy.workflow(galaxy.read_steps(s, path), galaxy.read_tools(s, tools), galaxy.read_data_types(s, types))[:3])


def read_workflow(spark: SparkSession, path: str) -> Graph:
    """The graph of a workflow file, by its ending."""
    ending = spark.range(1).select(suffix(F.lit(path))).first()[0]
    if ending not in _languages:
        raise ValueError(f"no language for {path}; known endings are {', '.join(sorted(_languages))}")
    return _languages[ending](spark, path)


#: How a script of each foreign language is run; others can be added.
INTERPRETERS = {"bash": ["bash", "-c"], "python": ["python3", "-c"], "perl": ["perl", "-e"], "r": ["Rscript", "-e"]}


def run_commands(tasks: DataFrame, allow: bool = False, tries: int = 2, seconds: float = 60.0) -> DataFrame:
    """(id, exit_code, stdout, stderr, tries) of scripts (id, command, and lang if there is such a column, else bash), run
    on the workers: a task that fails is tried again; one in an unknown language has the exit code 127. Scripts are
    arbitrary code, so that allow must be set."""
    if not allow:
        raise PermissionError("run_commands runs arbitrary code on the workers; set allow=True if that is meant")

    known = dict(INTERPRETERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, command, lang in zip(f["id"], f["command"], f["lang"]):
                for n in range(1, tries + 1):
                    try:
                        p = subprocess.run([*known[lang], command], capture_output=True, text=True, timeout=seconds, check=False)
                        got = (p.returncode, p.stdout, p.stderr)
                    except (KeyError, FileNotFoundError):
                        got = (127, "", f"no interpreter for {lang}")
                    except subprocess.TimeoutExpired:
                        got = (-1, "", f"stopped after {seconds} s")
                    if got[0] == 0:
                        break
                out.append((i, *got, n))
            yield pd.DataFrame(out, columns=["id", "exit_code", "stdout", "stderr", "tries"])

    lang = F.lower(F.coalesce("lang", F.lit("bash"))) if "lang" in tasks.columns else F.lit("bash")
    return tasks.select("id", "command", lang.alias("lang")).mapInPandas(run, "id string, exit_code int, stdout string, stderr string, tries int")


def new_nodes(stream: DataFrame) -> DataFrame:
    """Nodes (run, id, ...) of a graph that is not known beforehand, each as it first arrives in a stream."""
    return stream.dropDuplicates(["run", "id"])


def totals(tasks: DataFrame, by: list[str], previous: int = 0) -> DataFrame:
    """(by..., ready, running, finished, total) of tasks with a state; those of earlier runs (previous) don't count."""
    n = lambda s: F.count_if(F.col("state") == s)
    counted = tasks.groupBy(*by).agg(n("ready").alias("ready"), n("running").alias("running"), (n("finished") - previous).alias("finished"), n("waiting").alias("waiting"))
    return counted.withColumn("total", F.col("finished") + F.col("running") + F.col("ready") + F.col("waiting"))


def is_done(tasks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., done): neither a ready nor a running task is left."""
    return tasks.groupBy(*by).agg((F.count_if(F.col("state").isin("ready", "running")) == 0).alias("done"))


def input_bytes(files: DataFrame, host_files: DataFrame, by: list[str]) -> DataFrame:
    """(by..., host, total_bytes, local_bytes): a task's input bytes, and those that a host has already (file, host)."""
    total = files.groupBy(*by).agg(F.sum("size").alias("total_bytes"))
    local = files.join(host_files, "file").groupBy(*by, "host").agg(F.sum("size").alias("local_bytes"))
    return total.join(local, by)


def mapped_state(state: Column, mapping: dict[str, str]) -> Column:
    """The same for JSON text: its atoms looked up, nulls left out; text that isn't JSON is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(mapped_values(json.loads(t), mapping), separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(state)


def mapped_values(value, mapping: dict):
    """A parameter tree with its atoms looked up in a mapping, and without nulls."""
    if isinstance(value, dict):
        return {k: mapped_values(v, mapping) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [mapped_values(v, mapping) for v in value if v is not None]
    return mapping.get(value, value) if isinstance(value, str) else value


def table_parameters(tools: DataFrame, rows: DataFrame) -> DataFrame:
    """(tool_id, param, value, content) of parameters that take their values from reference tables (table, value, content)."""
    asked = tools.select("tool_id", F.explode("tables").alias("t")).select("tool_id", F.col("t.param").alias("param"), F.col("t.table").alias("table"))
    return asked.join(rows, "table").select("tool_id", "param", "value", "content")
