"""The given star schema seen as provenance: which tables play which part of the model.

events: one row is an invocation of a task (event_type) on a host (user_id) in a run (the day of ts); it took `value`.
orders are runs (o_orderpriority is the workflow's name), lineitem their invocations, part the tasks, supplier the
hosts. part also is a task graph: the parents of task k are k div 2 and k div 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    """Microseconds of a time stamp without zone, taken as UTC; days and the time in them, so that no session's zone has a say."""
    t = F.col(c)
    day = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, invoc_id, task, host, us, ms, real_time, props) of events."""
    e = read(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return e.select(F.to_date("ts").cast("string").alias("run_id"), F.col("event_id").alias("invoc_id"), F.col("event_type").alias("task"), F.col("user_id").alias("host"), "us", (F.col("us") / 1000.0).alias("ms"), F.col("value").alias("real_time"), "props")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (run, id, name, cost) and edges (run, a, b) of the tasks from 1 on, one run."""
    part = read(spark, sf_dir, "part").filter("p_partkey >= 1")
    nodes = part.select(F.lit(0).alias("run"), F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_size").cast("double").alias("cost"))
    up = nodes.filter("id > 1").select("run", F.explode(F.array_distinct(F.array(F.expr("id div 2"), F.expr("id div 3")))).alias("a"), F.col("id").alias("b"))
    return nodes, up.filter("a >= 1")
