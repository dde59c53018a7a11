"""Connected components of an undirected graph whose edges stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_iter, stored

#: Edges that one task contracts at a time.
CHUNK = 200_000


def union_edges(a: list[int], b: list[int]) -> dict[int, int]:
    """Node to root of the forest that the edges span; only nodes that are not their own root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up) if root(x) != x}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to a star for each component among a chunk of them."""

    def out(a: list[int], b: list[int]) -> pa.RecordBatch:
        stars = union_edges(a, b)
        return pa.RecordBatch.from_arrays([pa.array(list(stars), pa.int64()), pa.array(list(stars.values()), pa.int64())], ["a", "b"])

    a: list[int] = []
    b: list[int] = []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= CHUNK:
            yield out(a, b)
            a, b = [], []
    if a:
        yield out(a, b)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, comp), comp being one node of each component.

    In each round tasks contract chunks of CHUNK edges to stars. Once a single chunk is left, its stars are the
    components. Before, every node goes to the neighbour (or itself) of least hash, with another hash each round, and
    the ends of edges are replaced; the number of edges falls by a constant factor, so rounds grow with the logarithm.
    Hubs are joined on and pre-aggregated, never gathered. Loops and repeated edges do no harm; null ends are ignored;
    no edges give no rows.
    """
    left = stored(edges.select("a", "b").dropna().filter("a <> b"))
    maps: list[DataFrame] = []
    while n := left.count():
        chunks = -(-n // CHUNK)
        stars = stored(map_iter(left.coalesce(chunks), _contract, "a long, b long"))
        dropped(left)
        if chunks == 1:
            maps.append(stars.union(stars.select("b", "b").distinct()).toDF("a", "m"))
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), c.alias("x"))  # noqa: E731, B023
        both = stars.union(stars.select("b", "a"))
        to = stored(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select("a", F.least("m", rank(F.col("a")))["x"].alias("m")))
        maps.append(to)
        ends = stars.join(to.toDF("a", "ma"), "a").join(to.toDF("b", "mb"), "b").filter("ma <> mb")
        left = stored(ends.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
        dropped(stars)
    if not maps:
        return left.toDF("node", "comp")
    out = maps.pop().toDF("node", "comp")
    while maps:
        out = maps.pop().toDF("node", "m").join(out.toDF("m", "c"), "m", "left").select("node", F.coalesce("c", "m").alias("comp"))
    return stored(out)


def spanning_forest(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of distinct 64-bit values, (value, those newly reached from it at `bits` or fewer differing bits): at most as
    many links in all as there are values, yet the same components as all pairs give."""
    rest = values
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                yield x, found
