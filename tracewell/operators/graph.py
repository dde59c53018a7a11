"""Task graphs: depth, upward rank, roots, leaves, readiness, producers and consumers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Nodes and edges of a graph that one task takes whole.
FITS = 4_000_000


def _in_one_pass(nodes: pd.DataFrame, edges: pd.DataFrame) -> np.ndarray:
    """Values of a graph's nodes, whose parents come before them: all nodes without open parents at a time."""
    at = pd.Index(nodes["id"])
    a, b = at.get_indexer(edges["a"]), at.get_indexer(edges["b"])
    known = (a >= 0) & (b >= 0)
    order = np.argsort(a[known], kind="stable")
    a, b = a[known][order], b[known][order]
    begins = np.searchsorted(a, np.arange(len(nodes) + 1))
    cost = nodes["cost"].to_numpy()
    value, waits = cost.copy(), np.bincount(b, minlength=len(nodes))
    free, seen = np.flatnonzero(waits == 0), 0
    while len(free):
        seen += len(free)
        n = begins[free + 1] - begins[free]
        out = np.repeat(begins[free] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to = b[out]
        np.maximum.at(value, to, cost[to] + value[a[out]])
        np.subtract.at(waits, to, 1)
        free = np.unique(to[waits[to] == 0])
    if seen < len(nodes):
        raise ValueError("the graph has a cycle")
    return value


def _by_rounds(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """The same for graphs of any size: rounds send values along the edges of nodes that rose in the last round. Their
    number is the length of the longest path; as many rounds as there are nodes mean a cycle."""
    count = Observation()
    own = stored(nodes.select(*by, "id", F.col("cost").alias("value"), "cost").observe(count, F.count(F.lit(1)).alias("n")))
    links = stored(edges.select(*by, "a", "b"))  # read in every round
    rose = own
    for _ in range(count.get["n"] + 1):
        sent = rose.withColumnRenamed("id", "a").join(links, [*by, "a"]).groupBy(*by, F.col("b").alias("id")).agg(F.max("value").alias("_got"))
        seen = Observation()
        new = own.join(sent, [*by, "id"], "left").select(*by, "id", F.greatest("value", F.col("cost") + F.col("_got")).alias("value"), "cost", F.coalesce(F.col("cost") + F.col("_got") > F.col("value"), F.lit(False)).alias("_rose"))
        new = stored(new.observe(seen, F.count_if("_rose").alias("rose")))
        dropped(own)
        if not seen.get["rose"]:
            dropped(links)
            return new.select(*by, "id", "value")
        own, rose = new, new.filter("_rose").select(*by, "id", "value", "cost")
    raise ValueError("the graph has a cycle")


def longest(nodes: DataFrame, edges: DataFrame, by: list[str], fits: int = FITS) -> DataFrame:
    """(by..., id, value): a node's cost plus the largest value among those that point to it (edges a to b).

    Graphs of `fits` nodes and edges at most, counted, are worked on whole and side by side, one task each, in the order
    of their edges; if any is larger, all go by rounds of joins. Edges from or to unknown nodes don't count. A cycle
    raises an error either way, whatever the length of the longest path.
    """
    sizes = nodes.select(*by).unionAll(edges.select(*by)).groupBy(*by).count()
    if (sizes.agg(F.max("count")).first()[0] or 0) > fits:
        return _by_rounds(nodes, edges, by)
    types = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*by, "id"]) + f", value {types['cost']}"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a[[*by, "id"]].assign(value=_in_one_pass(a, b)) if len(a) else pd.DataFrame({c: [] for c in [*by, "id", "value"]})

    left, right = nodes.select(*by, "id", "cost").toDF(*by, "id", "cost"), edges.select(*by, "a", "b").toDF(*by, "a", "b")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)


def depths(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges on the longest path from a root: 0 for roots."""
    inner = nodes.select(*by, "id").join(edges.select(*by, F.col("b").alias("id")).distinct().withColumn("_in", F.lit(1)), [*by, "id"], "left")
    return longest(inner.select(*by, "id", F.coalesce("_in", F.lit(0)).alias("cost")), edges, by).withColumnRenamed("value", "depth")


def upward_ranks(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Cost of a node plus the largest rank of its children."""
    return longest(nodes, edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")), by).withColumnRenamed("value", "upward_rank")


def roots_and_leaves(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, is_root, is_leaf)."""
    ends = lambda c, name: edges.select(*by, F.col(c).alias("id")).distinct().withColumn(name, F.lit(True))
    both = nodes.select(*by, "id").join(ends("b", "_has_parent"), [*by, "id"], "left").join(ends("a", "_has_child"), [*by, "id"], "left")
    return both.select(*by, "id", F.col("_has_parent").isNull().alias("is_root"), F.col("_has_child").isNull().alias("is_leaf"))


def ready(nodes: DataFrame, edges: DataFrame, completed: DataFrame, by: list[str]) -> DataFrame:
    """Nodes that aren't completed and whose parents all are."""
    waiting = edges.join(completed.select(*by, F.col("id").alias("a")), [*by, "a"], "left_anti").select(*by, F.col("b").alias("id"))
    return nodes.join(completed.select(*by, "id"), [*by, "id"], "left_anti").join(waiting, [*by, "id"], "left_anti")


def producer_consumer_edges(outputs: DataFrame, inputs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., a, b) from the last producer of a file to each consumer; a task that reads its own file has no edge."""
    last = outputs.groupBy(*by, "file").agg(F.max_by("id", F.struct(*order)).alias("a"))
    return last.join(inputs.select(*by, "file", F.col("id").alias("b")), [*by, "file"]).filter("a <> b").select(*by, "a", "b").distinct()
