"""Other stores of provenance: databases by JDBC, documents with maps, and views in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..plans import ingest
from ..plans.provenance import Store, with_files

TABLES = ("workflowrun", "task", "invocation", "file", "inoutput", "userevent", "engineevent", "accesstime")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, least: int, most: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational store, read side by side in ranges of a numeric key; filters are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(least), upperBound=str(most), numPartitions=str(parts), **options)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def run_documents(entries: DataFrame) -> DataFrame:
    """One document per run: name, time, the set of its tasks, and the latest engine event of each type as a map."""
    events = ingest.events(entries, latest=True).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "content"))).alias("events"))
    return ingest.runs(entries).join(events, "run_id", "left")


def invocation_documents(entries: DataFrame) -> DataFrame:
    """One document per invocation, stamped by its last entry, with maps of its files and texts."""
    own = with_files(ingest.invocations(entries, "last"), ingest.files(entries))
    order = F.struct("source", "line_no")
    text = entries.filter(F.col("key").isin(S.SCRIPT, S.OUTPUT)).groupBy("run_id", "invoc_id", "key").agg(F.max_by("value", order).alias("value"))
    texts = text.groupBy("run_id", "invoc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("texts"))
    return own.join(texts, ["run_id", "invoc_id"], "left")


def forget(store: Store) -> None:
    """Gives the memory of an in_memory() store back; its views are made anew if they are asked again."""
    for view in (store.invocations, store.runs, store.tasks, store.files):
        if view is not None:
            view.unpersist()


def in_memory(entries: DataFrame) -> Store:
    """A store of views over an event log, kept in memory and on disk as far as it fits, until forget(); an invocation is
    stamped by its run time entry and -1 before."""
    keep = lambda df: df.persist()
    return Store(keep(ingest.invocations(entries, "time")), keep(ingest.runs(entries)), keep(ingest.tasks(entries)), keep(ingest.files(entries)))
