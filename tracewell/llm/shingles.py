"""Near duplicates by exact Jaccard likeness of word shingles; MinHash bands only narrow down what is compared.

Texts with equal sets of shingles are one node. BANDS keys of ROWS minima each say which nodes may be alike: of two
sets with a likeness of 0.8 all but 5 in 10^8 have a key in common. Nodes that keys connect form a group, and within a
group all likenesses of the threshold or more are found from lists of the nodes that hold a shingle. Links are those of
a spanning forest, so that a crowd of near copies doesn't give all its pairs; groups of over MANY nodes are dealt to
pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_bytes, fresh, map_batches, map_iter, slices, spread_join, stored
from .components import connected_components
from .line_dedup import BASES, grams

WORDS, LIKENESS, BANDS, ROWS, MANY = 5, 0.8, 32, 4, 500
_of = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
TIMES, PLUS = _of[0] * np.uint64(2) + np.uint64(1), _of[1]
#: Shingles whose minima are taken at a time.
STEP = 1024


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of each `words` words in a row, A-Z lower-cased; of all words, if they are fewer."""
    w = (text or b"").lower().split()
    return np.unique(grams(w, min(words, len(w)), BASES[0])) if w else np.empty(0, np.uint64)


def node(s: np.ndarray) -> int:
    """A set as 64 bits, signed; the empty one is 0."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def keys(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), STEP):
        np.minimum(least, (s[i : i + STEP] * TIMES + PLUS).min(axis=1), out=least)
    x = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(x)], np.uint64).view(np.int64)


def _nodes(docs: DataFrame, words: int, bits: int | None) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(x.as_py(), words) for x in as_bytes(b.column(1))]
        each = [keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
        fps = np.fromiter((0 if bits is None else simhash.fingerprint(x.as_py()) for x in as_bytes(b.column(1))), np.uint64, b.num_rows).view(np.int64)
        columns = [b.column(0), pa.array([node(s) for s in sets], pa.int64()), pa.array(each, pa.list_(pa.int64())), pa.array(fps)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "keys", "fp"])

    return map_batches(docs, run, "doc_id long, node long, keys array<long>, fp long")


def _fingerprint_links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b) links between nodes of rows (doc_id, node, fp) whose SimHash fingerprints are linked, over any number of
    links; fingerprints of rows without a doc_id are among them."""
    of = connected_components(simhash.links(rows, bits)).toDF("fp", "comp")
    pairs = rows.filter("doc_id is not null").select("node", "fp").distinct()
    named = stored(pairs.join(of, "fp", "left").select(F.coalesce("comp", "fp").alias("comp"), "node").distinct())
    first = named.groupBy("comp").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("comp", "a")
    return spread_join(named, stored(first), ["comp"]).filter("a <> node").select("a", F.col("node").alias("b"))


def forest(sets: list[np.ndarray], threshold: float = LIKENESS) -> Iterator[tuple[int, int]]:
    """Links (places of two sets) that span the same components as all pairs with a likeness of the threshold or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), sizes)[np.argsort(which, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(which))])
    rest = np.ones(n, bool)
    for root in range(n):
        if not rest[root]:
            continue
        rest[root] = False
        todo = [root]
        while todo and rest.any():
            x = todo.pop()
            own = which[ends[x] - sizes[x] : ends[x]]
            many = upto[own + 1] - upto[own]
            at = np.repeat(upto[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = np.bincount(holder[at], minlength=n)
            found = np.flatnonzero(rest & (both >= threshold * (sizes[x] + sizes - both) - 1e-9))
            rest[found] = False
            todo.extend(found.tolist())
            yield from ((x, y) for y in found.tolist())


def _links(threshold: float):
    """Rows (key, node, set) sorted by key to the links within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            nodes = list(group)
            found = list(forest([np.frombuffer(group[x], np.uint64) for x in nodes], threshold)) if len(nodes) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for k, x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if k != key:
                    yield from out()
                    key, group = k, {}
                group[x] = s.as_py()
        yield from out()

    return run


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS, threshold: float = LIKENESS) -> DataFrame:
    """(a, b) links between nodes (node, least, keys) whose components are those of all pairs that are alike; the texts
    are those of docs (doc_id, text) with the least doc_id of each node."""
    each = stored(nodes.select("node", F.explode("keys").alias("key")))
    stars = each.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    groups = connected_components(each.join(stars, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    sizes = stored(groups.groupBy("comp").agg(F.count("*").alias("n")))
    blocks = F.ceil(F.col("n") / MANY).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    dealt = spread_join(groups, sizes, ["comp"]).withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("node", F.xxhash64("comp", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
    asked = dealt.groupBy("node").agg(F.collect_list("key").alias("keys")).join(nodes.select("node", "least"), "node")
    texts = docs.join(asked.withColumnRenamed("least", "doc_id"), "doc_id").select("text", "node", "keys")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in slices(as_bytes(b.column(0)), 1_000_000):
            rows = []
            for x, of, ks in zip(as_bytes(b.column(0).slice(i, j - i)), b.column(1).slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i).to_pylist()):
                s = shingles(x.as_py(), words)
                if node(s) == of:  # of several rows with this doc_id
                    rows += [(k, of, s.tobytes()) for k in ks]
            if rows:
                k, of, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(of, pa.int64()), pa.array(s, pa.binary())], ["key", "node", "s"])

    sets = map_batches(texts, run, "key long, node long, s binary")
    return map_iter(sets.repartition("key").sortWithinPartitions("key"), _links(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = LIKENESS, bits: int | None = None) -> DataFrame:
    """(doc_id, component_id): documents that are linked, over any number of links, share the smallest doc_id of them.

    With bits, documents are also linked as op5_simhash does: by fingerprints that differ in at most so many bits, those
    of rows without a doc_id in between, too. Texts without a word (null ones too) are alike. Other than that rows
    without a doc_id have no part; repeated rows stay repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stored(_nodes(rows, words, bits))
    rows, own = rows.filter("doc_id is not null"), every.filter("doc_id is not null")
    nodes = stored(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")))
    edges = links(rows, nodes, words, threshold)
    comps = connected_components(edges if bits is None else edges.union(_fingerprint_links(every, bits))).toDF("node", "comp")
    named = stored(nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least"))
    least = stored(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    ids = stored(spread_join(named, least, ["comp"]).select("node", "component_id"))
    return spread_join(own.select("doc_id", "node"), ids, ["node"]).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, words: int = WORDS, threshold: float = LIKENESS, bits: int | None = None) -> DataFrame:
    """docs without those that are not the first (smallest doc_id) of their component; all columns and all rows without
    a doc_id are kept."""
    gone = fresh(docs, "_gone")
    later = near_duplicates(docs, words, threshold, bits).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(later, docs["doc_id"] == later[gone], "left_anti")
