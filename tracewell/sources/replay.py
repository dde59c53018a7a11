"""The task graph of a finished run, read back from its event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.scalar import split_list
from ..operators.graph import producer_consumer_edges


def replayed(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (run, id, name, lang, command), edges (run, a, b), outputs (run, file) of entries (source, line_no, ...).

    A node is an invocation; its files are those whose sizes were logged; its command is the last script. The last
    producer of a file is its producer. Workflow outputs come from the output list.
    """
    order = F.struct("line_no")
    rows = entries.withColumn("run", F.col("source")).filter("invoc_id is not null and invoc_id <> 0")
    script = F.when(F.col("key") == S.SCRIPT, F.col("value"))
    nodes = rows.groupBy("run", F.col("invoc_id").alias("id")).agg(
        F.min_by("task_name", F.when(F.col("task_name").isNotNull(), order)).alias("name"), F.min_by("lang", F.when(F.col("lang").isNotNull(), order)).alias("lang"),
        F.max_by(script, F.when(script.isNotNull(), order)).alias("command"),
    )
    io = lambda key: rows.filter(F.col("key") == key).select("run", F.col("invoc_id").alias("id"), "file", "line_no")
    edges = producer_consumer_edges(io(S.FILE_SIZE_OUT), io(S.FILE_SIZE_IN), ["run"], ["line_no"])
    outputs = entries.filter(F.col("key") == S.WF_OUTPUT).select(F.col("source").alias("run"), F.explode(split_list(F.col("value"))).alias("file")).distinct()
    return nodes, edges, outputs
