"""Event logs and the small text formats around them.

Spark has no line numbers. Files are read in splits; a pass over the splits counts their lines, and a line's number is
that of the lines in the splits before it and of those before it in its own. That gives a total order (source, line_no)
over any number of files of any size.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import schema as S
from ..functions.schema import ENTRY, FIELDS

#: Workflow languages by file suffix. Unlike a bare string ending the dot counts: "a.xml" is one, "axml" is none.
LANGUAGES = {"cf": "functional", "xml": "dax", "dax": "dax", "ga": "galaxy", "log": "log"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no from 1, line) of files, in file order; blank lines count."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    # a split's lines are read in order, one after the other
    splits = lines.groupBy("source", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(splits, ["source", "_block"]).select("source", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def entries(lines: DataFrame) -> DataFrame:
    """Entries of lines (source, line_no, line): blank lines are skipped, surrounding white space is ignored; a line that
    isn't JSON has null in all fields."""
    kept = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    return kept.withColumn("e", F.from_json("line", ENTRY)).select("source", "line_no", *(F.col(f"e.{c}").alias(c) for c in FIELDS))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one log, of a folder or of a glob such as <base>/<cache>/*/*.log."""
    return entries(read_lines(spark, path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The set of entries of a task's report."""
    return read_log(spark, path).select(*FIELDS).dropDuplicates()


def as_lines(df: DataFrame) -> DataFrame:
    """(value) JSON text of entries; null fields are left out, values that are JSON objects stay text."""
    return df.select(F.to_json(F.struct(*FIELDS)).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    as_lines(df).write.mode("append").text(path)


def write_normalised(cleaned: DataFrame, path: str) -> None:
    """Cleaned entries in the order of time and file."""
    as_lines(cleaned.orderBy("timestamp", "source", "line_no")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def summary(outputs: DataFrame, stdout: str, stderr: str, log: str) -> DataFrame:
    """One row of JSON: output files, and where standard output, standard error and the log are."""
    listed = outputs.agg(F.sort_array(F.collect_list("file")).alias("output"))
    return listed.select(F.to_json(F.struct("output", F.lit(stdout).alias("stdout"), F.lit(stderr).alias("stderr"), F.lit(log).alias("statlog"))).alias("value"))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of lines with an equals sign; comments begin with # or ;."""
    lines = spark.read.text(path).withColumn("value", F.trim("value")).filter(~F.col("value").rlike(r"^[#;\[]") & F.col("value").contains("="))
    return lines.select(F.trim(F.split("value", "=", 2)[0]).alias("name"), F.trim(F.split("value", "=", 2)[1]).alias("value"))


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """(name, mb) of a JSON object of task names."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "mb"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, container, is_output) of staging manifests: a count, so many lines path[,container], a count, paths."""
    return manifest_rows(read_lines(spark, path))


def manifest_rows(lines: DataFrame) -> DataFrame:
    """The same of lines (source, line_no, line)."""
    lines = lines.withColumn("line", F.trim("line"))
    first = lines.filter("line_no = 1").select("source", F.col("line").try_cast("int").alias("n"))
    rows = lines.join(first, "source").filter("line_no > 1 and line_no <> n + 2 and line <> ''")
    parts = F.split("line", ",", 2)
    return rows.select("source", parts[0].alias("path"), F.try_element_at(parts, F.lit(2)).alias("container"), (F.col("line_no") > F.col("n") + 1).alias("is_output"))


def manifests(files: DataFrame) -> DataFrame:
    """(task, value) the staging manifest of each task as text, from files (task, path, container, is_output): the number
    of inputs, their lines path[,container] by path, the number of outputs, their paths."""
    line = F.when(F.col("container").isNull() | F.col("is_output"), F.col("path")).otherwise(F.concat("path", F.lit(","), "container"))
    of = lambda c: F.array_sort(F.collect_list(F.when(c, line)))
    both = files.groupBy("task").agg(of(~F.col("is_output")).alias("i"), of(F.col("is_output")).alias("o"))
    count = lambda c: F.array(F.size(c).cast("string"))
    return both.select("task", F.array_join(F.concat(count("i"), "i", count("o"), "o"), "\n").alias("value"))


def write_manifests(files: DataFrame, path: str) -> None:
    """One folder for each task (task=...), with its manifest."""
    manifests(files).write.mode("overwrite").partitionBy("task").text(path)


def staged(moved: DataFrame, sizes: bool = True) -> DataFrame:
    """Entries of moved files (run_id, task_id, task_name, lang, invoc_id, file, is_output, begin, end in ms, size): the
    time that each took, and its size if asked for, stamped with the begin."""
    key = lambda i, o: F.when(F.col("is_output"), o).otherwise(i)
    took = F.concat(F.lit('{"realTime":"'), (F.col("end") - F.col("begin")).cast("string"), F.lit('"}'))
    each = [F.struct(key(S.FILE_TIME_IN, S.FILE_TIME_OUT).alias("key"), took.alias("value"))]
    each += [F.struct(key(S.FILE_SIZE_IN, S.FILE_SIZE_OUT).alias("key"), F.col("size").cast("string").alias("value"))] if sizes else []
    rows = moved.withColumn("e", F.explode(F.array(*each))).select(F.col("begin").alias("timestamp"), "run_id", "task_id", "task_name", "lang", "invoc_id", "file", "e.key", "e.value")
    return rows.select(*FIELDS)


def stage(files: DataFrame) -> DataFrame:
    """Copies files (..., source, target: URIs) on the workers, and adds begin, end (ms) and size. A file that is copied
    again is overwritten, so that a repeated task does no harm."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            out = []
            for source, target in zip(f["source"], f["target"]):
                tic = time.time_ns() // 1_000_000
                (a, b), (x, y) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
                x.create_dir(y.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(b, y, source_filesystem=a, destination_filesystem=x)
                out.append((tic, time.time_ns() // 1_000_000, x.get_file_info(y).size))
            yield f.assign(**dict(zip(("begin", "end", "size"), map(list, zip(*out))))) if out else f.assign(begin=0, end=0, size=0)

    kinds = ", ".join(f"{c} {t}" for c, t in files.dtypes)
    return files.mapInPandas(run, f"{kinds}, begin long, end long, size long")


def read_data_table(spark: SparkSession, path: str, columns: list[str], comment: str = "") -> DataFrame:
    """Tab-separated reference table; lines that begin with the comment text are skipped, none if it is empty."""
    rows = spark.read.text(path).filter("trim(value) <> ''")
    if comment:
        rows = rows.filter(~F.col("value").startswith(comment))
    parts = F.split("value", "\t")
    return rows.select(*(F.try_element_at(parts, F.lit(i)).alias(c) for i, c in enumerate(columns, 1)))


def language(path: Column) -> Column:
    """Workflow language of a path by its suffix; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), scalar.suffix(path))


def resolved(files: DataFrame, container_dir: str, base_dir: str, app_dir: str, present: DataFrame) -> DataFrame:
    """files (file, container) with path: in the container's folder if it has one, else in the base folder if it is
    there (present: path), else in the application's."""
    base = F.concat(F.lit(base_dir + "/"), "file")
    known = present.select(F.col("path").alias("_p")).distinct()
    found = files.join(known, base == F.col("_p"), "left")
    own = F.concat(F.lit(container_dir + "/"), "container", F.lit("/"), "file")
    return found.withColumn("path", F.when(F.col("container").isNotNull(), own).when(F.col("_p").isNotNull(), base).otherwise(F.concat(F.lit(app_dir + "/"), "file"))).drop("_p")


def amplified(runs: DataFrame, times: int, millis: int, most: int | None = None) -> DataFrame:
    """runs (run_id, ...) `times` over, with ids of 36 characters, an underscore and a number that grows with the copy;
    `most` copies at most, the first ones by copy and run."""
    copies = runs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    copies = copies if most is None else copies.orderBy("copy", "run_id").limit(most)
    return copies.withColumn("run_id", scalar.clone_id(F.col("run_id"), F.lit(millis) + F.col("copy")))


def amplified_model(runs: DataFrame, invocations: DataFrame, files: DataFrame, times: int, millis: int, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs, invocations and files (all by run_id) of copied runs; copied invocations are stamped with the copy's time."""
    copies = runs.withColumn("_of", F.col("run_id"))
    copies = amplified(copies, times, millis, most)
    ids = copies.select(F.col("_of").alias("run_id"), F.col("run_id").alias("_new"), "copy")
    renamed = lambda df: df.join(ids, "run_id").withColumn("run_id", F.col("_new")).drop("_new")
    stamped = renamed(invocations).withColumn("timestamp", F.lit(millis) + F.col("copy")).drop("copy")
    return copies.drop("_of", "copy"), stamped, renamed(files).drop("copy")
