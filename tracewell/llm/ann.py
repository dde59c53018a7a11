"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

A unit vector is a multiple of a coarse unit centre plus a residual across it; the multiple and the residual's length are
kept, its direction is quantised by products of 16 centres in subspaces of two dimensions. The loss weighs the error parallel to the vector more than the one across
it, since only the former changes large inner products. A scan adds up table entries of 4-bit codes, two to a byte;
each query's best candidates of each block are ranked again by the exact cosine in double precision. Within a crowd of
nearly equal vectors the residuals still tell them apart, as they are scaled; of equal vectors no more are looked at
than a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_iter, stored

#: Vectors that centres are learned from at most, coarse centres, rows of a block, candidates ranked again of each block.
SAMPLE, COARSE, ROWS, AGAIN = 8_000, 256, 4_096, 64
SUB, CENTRES, ROUNDS, THRESHOLD = 2, 16, 3, 0.2
#: Queries whose table entries are added up at a time; bytes of the queries that are broadcast at a time.
STEP, ASKED = 128, 32 << 20


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual for inner products above the threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


@dataclass
class Quantiser:
    """coarse: unit centres x dim; centres: subspaces x 16 x SUB."""

    coarse: np.ndarray
    centres: np.ndarray
    dim: int

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = self.centres.shape[0] * SUB - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centre of each unit vector, its multiple, and length and direction of the residual."""
        leaf = (x @ self.coarse.T).argmax(1)
        c = self.coarse[leaf]
        multiple = (x * c).sum(1)
        rest = x - multiple[:, None] * c
        scale = np.sqrt((rest * rest).sum(1))
        return leaf, multiple, scale, rest / np.maximum(scale, 1e-12)[:, None]

    def encode(self, x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centres, multiples, scales and codes (n x subspaces) of unit vectors, the codes by coordinate descent on
        the anisotropic loss from nearest centres. The multiple makes up for what the codes add along the centre."""
        leaf, multiple, scale, u = self.parts(x)
        codes = descend(self.split(u), self.split(x), self.centres, eta(self.dim), None, rounds)
        coded = self.centres[np.arange(len(self.centres)), codes].reshape(len(x), -1)[:, : self.dim]
        return leaf, multiple - scale * (coded * self.coarse[leaf]).sum(1), scale, codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with centres, for pairs of subspaces: queries x bytes x 256."""
        one = np.einsum("qms,mcs->qmc", self.split(q), self.centres).astype(np.float32)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)

    def scores(self, q: np.ndarray, leaf: np.ndarray, multiple: np.ndarray, scale: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of unit queries with rows (codes: bytes x rows)."""
        tables = self.tables(q)
        out = np.zeros((len(q), len(leaf)))
        for byte, row in enumerate(codes):
            out += tables[:, byte].take(row, axis=1)
        out *= scale
        out += (q @ self.coarse.T).take(leaf, axis=1) * multiple
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)


def descend(x: np.ndarray, d: np.ndarray, centres: np.ndarray, weight: float, codes: np.ndarray | None, rounds: int) -> np.ndarray:
    """Codes of x by turns over subspaces: least squared error, the part of it along d counting `weight` times."""
    n, m, _ = x.shape
    if codes is None:
        codes = np.stack([((x[:, k, None] - centres[k]) ** 2).sum(-1).argmin(1) for k in range(m)], 1)
    along = np.stack([((x[:, k] - centres[k][codes[:, k]]) * d[:, k]).sum(-1) for k in range(m)], 1)
    total = along.sum(1)
    for _ in range(rounds):
        for k in range(m):
            r = x[:, k, None] - centres[k]
            own = (r * d[:, k, None]).sum(-1)
            rest = total - along[:, k]
            loss = (r**2).sum(-1) + (weight - 1) * (rest[:, None] + own) ** 2
            codes[:, k] = loss.argmin(1)
            along[:, k] = own[np.arange(n), codes[:, k]]
            total = rest + along[:, k]
    return codes


def clustered(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from rows drawn at random; a centre without rows stays where it is."""
    c = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        count = np.bincount(at, minlength=n)
        sums = np.stack([np.bincount(at, x[:, s], n) for s in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def learn(x: np.ndarray, seed: int = 5) -> Quantiser:
    """Centres from unit vectors: k-means, coarse and in each subspace of the residuals' directions, then turns of
    anisotropic codes and least-squares centres."""
    dim = x.shape[1]
    m = -(-dim // SUB)
    rng, weight = np.random.default_rng(seed), eta(dim)
    coarse = clustered(x, max(1, min(COARSE, len(x) // 16)), 6, rng)
    size = np.sqrt((coarse * coarse).sum(1, keepdims=True))
    q = Quantiser(np.where(size > 1e-9, coarse / np.maximum(size, 1e-9), x[:1]), np.zeros((m, CENTRES, SUB)), dim)
    parts, d = q.split(q.parts(x)[3]), q.split(x)
    for k in range(m):
        q.centres[k] = clustered(parts[:, k], CENTRES, 8, rng)
    codes = None
    for _ in range(ROUNDS):
        codes = descend(parts, d, q.centres, weight, codes, 1)
        along = ((parts - q.centres[np.arange(m), codes]) * d).sum(-1)
        total = along.sum(1)
        for k in range(m):
            t, w, rest = parts[:, k], d[:, k], total - along[:, k]
            for j in range(CENTRES):
                own = codes[:, k] == j
                if own.any():
                    a = own.sum() * np.eye(SUB) + (weight - 1) * w[own].T @ w[own]
                    b = t[own].sum(0) + (weight - 1) * ((rest[own] + (t[own] * w[own]).sum(1))[:, None] * w[own]).sum(0)
                    q.centres[k, j] = np.linalg.solve(a, b)
            along[:, k] = ((t - q.centres[k][codes[:, k]]) * w).sum(-1)
            total = rest + along[:, k]
    return q


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of vectors that take part: not null, not zero, all components finite."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(good)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(vec_id, v, leaf, multiple, scale, codes binary) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, multiple, scale, codes = shared.value.encode(_unit(_matrix(b.column(1))))
                columns = [pa.array(leaf, pa.int32()), pa.array(multiple, pa.float64()), pa.array(scale, pa.float64()), pa.array([c.tobytes() for c in packed(codes)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["vec_id", "v", "leaf", "multiple", "scale", "codes"])

    return map_iter(vectors, run, "vec_id long, v array<double>, leaf int, multiple double, scale double, codes binary")


def best(approx: np.ndarray, most: int) -> np.ndarray:
    """Columns of the largest entries of a row, ties to the first columns, in any order."""
    if len(approx) <= most:
        return np.arange(len(approx))
    least = np.partition(approx, len(approx) - most)[len(approx) - most]
    over = np.flatnonzero(approx > least)
    return np.concatenate([over, np.flatnonzero(approx == least)[: most - len(over)]])


def firsts(v: np.ndarray, most: int) -> np.ndarray:
    """Places of rows that are among the first `most` equal ones."""
    _, of = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])
    nth = np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)]))
    return np.sort(order[nth < most])


def scan(quantiser: Quantiser, block: tuple[np.ndarray, ...], query_ids: np.ndarray, q: np.ndarray, k: int, again: int):
    """(query_id, vec_id, score) of the k best of one block (ids, vectors, coarse centres, multiples, scales, codes) for each query,
    by codes and then by exact cosine."""
    order = np.argsort(block[0], kind="stable")
    order = order[firsts(block[1][order], k + 1)]  # one more, as the query itself may be among them
    ids, v, leaf, multiple, scale, codes = (x[order] for x in block)
    codes = np.ascontiguousarray(codes.T)
    norms, query_norms = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), STEP):
        approx = quantiser.scores(_unit(q[s : s + STEP]), leaf, multiple, scale, codes)
        for i, a in enumerate(approx, s):
            a[ids == query_ids[i]] = -np.inf
            near = best(a, again)
            near = near[ids[near] != query_ids[i]]
            score = (v[near] * q[i]).sum(axis=1) / (norms[near] * query_norms[i])
            top = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(top), query_ids[i]), ids[near][top], score[top]))
    return [np.concatenate(x) for x in zip(*out)]


def _nearest(quantiser, queries, k: int, again: int, rows: int):
    """Batches of an index to the k best of a partition for each of the queries (both broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

        def with_block(table: pa.Table) -> list[np.ndarray]:
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            block = (table.column("vec_id").to_numpy(), _matrix(table.column("v")), *(table.column(c).to_numpy() for c in ("leaf", "multiple", "scale")), codes)
            a, b, c = (np.concatenate(x) for x in zip(best, scan(quantiser.value, block, ids, q, k, again)))
            order = np.lexsort((b, -c, a))
            begins = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0])
            nth = np.arange(len(a)) - np.repeat(begins, np.diff(np.r_[begins, len(a)]))
            return [x[order[nth < k]] for x in (a, b, c)]

        waiting: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            for i in range(0, b.num_rows, rows):
                waiting.append(b.slice(i, rows))
                n += waiting[-1].num_rows
                if n >= rows:
                    best = with_block(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if n:
            best = with_block(pa.Table.from_batches(waiting))
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, again: int = AGAIN, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine, without those of its own vec_id.

    vectors and queries: (vec_id, embedding). Null, zero and non-finite vectors, null vec_ids, and vectors of another
    length than the most frequent take no part. Fewer than k candidates are all returned; no vectors give no rows.
    Ties go to the smaller vec_id; of queries with one vec_id the least vector is asked; repeated rows are candidates of
    their own. Centres come from a sample of at most SAMPLE vectors, chosen by a hash of vec_id;
    every row is indexed and scanned. Queries are broadcast, ASKED bytes of them at a time; against each such part every
    partition scans its vectors, `rows` at a time, and sends on its k best for each query. Vectors never leave their
    partition. `again` says how many of each `rows` are ranked again by their exact scores: with `again` = `rows` all
    are, which is the exact search.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, n = sizes[0]
    base = base.filter(F.size("v") == dim)
    asked = usable(queries).filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    m = asked.count()
    if not m:
        return empty
    hashed = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30))
    sample = base.filter(hashed < int((1 << 30) * min(1.0, SAMPLE / n))).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    sample = sample if sample.num_rows else base.limit(SAMPLE).toArrow()
    quantiser = learn(_unit(_matrix(sample.column("v"))))
    shared = spark.sparkContext.broadcast(quantiser)
    parts = -(-m * dim * 8 // ASKED)
    indexed = index(base, quantiser) if parts == 1 else stored(index(base, quantiser))
    asked = asked if parts == 1 else stored(asked)
    near = empty.drop("rank")
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)) == part).toArrow()
        if own.num_rows:
            queries_of = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), _matrix(own.column("v"))))
            near = near.unionByName(map_iter(indexed, _nearest(shared, queries_of, k, again, rows), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
