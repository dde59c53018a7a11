"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other. The
content view has the words and the make-up of the characters, the metadata view language, source and size alone.

Both are logistic regressions. In each round either one scores a pool of unlabelled documents, and those that it is
most sure of, in the proportions of the labels, join the other one's training set with its verdicts. In the end each
view's scores are calibrated on labelled documents that no training set holds, and the calibrated log odds are added.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, map_batches, slices

#: Bounds of the fit: labelled documents, documents of the pool, rounds, and the share of the pool that a view hands
#: over in a round.
LABELLED, POOL, ROUNDS, SHARE = 3_000, 2_000, 4, 0.08
#: Hashed features of the content view, and all of its features.
WIDTH = 1 << 13
CONTENTS = WIDTH + 12


BYTE_KIND = np.zeros(256, np.int64)
for _kind, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'", b"!#$%&*|<>=+@^~_/\\{}[]"), 1):
    BYTE_KIND[list(_of)] = _kind


def content(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word ends of a text, each a unit vector, and the make-up of its characters: features and their
    weights."""
    n = Counter(text.split())
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    kinds = np.bincount(BYTE_KIND[np.frombuffer(text, np.uint8)], minlength=8) / len(text)
    words = list(n)
    count = np.fromiter(n.values(), float, len(words))
    at = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % (WIDTH // 2)
    ends = np.fromiter((zlib.crc32(w[-2:]) for w in words), np.int64, len(words)) % (WIDTH // 2) + WIDTH // 2
    x = np.bincount(np.concatenate([at, ends]), np.concatenate([np.log1p(count), count]), WIDTH)
    x[: WIDTH // 2] /= max(1e-9, np.sqrt((x[: WIDTH // 2] ** 2).sum()))
    x[WIDTH // 2 :] /= max(1e-9, np.sqrt((x[WIDTH // 2 :] ** 2).sum()))
    x = np.concatenate([x, kinds * 4, np.sqrt(kinds[[1, 3, 6, 7]])])
    k = np.flatnonzero(x)
    return k, x[k]


#: Metadata: a constant, the size, and languages, sources and ranges of size by hashes, alone and in pairs.
SIZES, LANGS, SOURCES, PAIRS = 12, 8, 24, 64
METAS = 3 + SIZES + LANGS + SOURCES + PAIRS


def metadata(size: int, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of a page without its words: language, source and size in bytes."""
    x = np.zeros(METAS)
    level = np.log1p(size) / 10
    x[:3] = 1.0, level, level**2
    at, k = 3, min(SIZES - 1, int(np.log2(1 + size) * 0.75))
    x[at + k] = 0.5
    x[at + SIZES + zlib.crc32((lang or "").encode()) % LANGS] = 0.5
    x[at + SIZES + LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 0.5
    x[at + SIZES + LANGS + SOURCES + zlib.crc32(f"{lang or ''} {k}".encode()) % PAIRS] = 0.5
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse rows: features and weights one after the other, and each row's number of them."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.rows, self.width = rows, width
        self.at = np.concatenate([np.empty(0, np.int64), *(k for k, _ in rows)])
        self.x = np.concatenate([np.empty(0), *(v for _, v in rows)])
        self.of = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])

    def __len__(self) -> int:
        return len(self.rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.x * w[self.at], len(self))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.x * r[self.of], self.width)

    def take(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.rows[i] for i in which]


def fit(x: Rows, y: np.ndarray, decay: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights of a logistic regression, classes balanced, by accelerated gradient descent."""
    w = v = np.zeros(x.width)
    share = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean())) / len(y)
    rate = 4 / max(1e-9, float(np.bincount(x.of, x.x**2, len(x)).max()))
    for i in range(steps):
        u = v - rate * (x.back(share * (sigmoid(x.dot(v)) - y)) + decay * v)
        v, w = u + i / (i + 3) * (u - w), u
    return w


@dataclass
class Model:
    """Weights of both views, and slope and offset of each view's calibration."""

    content: np.ndarray
    metadata: np.ndarray
    slopes: list[float] = field(default_factory=lambda: [1.0, 1.0])
    offsets: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def odds(self, text: bytes, lang: str | None, source: str | None) -> tuple[float, float]:
        """Calibrated log odds of good quality by each view."""
        k, v = content(text)
        z = float(self.content[k] @ v), float(self.metadata @ metadata(len(text), lang, source))
        return self.slopes[0] * z[0] + self.offsets[0], self.slopes[1] * z[1] + self.offsets[1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of log odds over scores, by Newton steps with a little shrinkage."""
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = sigmoid(x @ a)
        g = x.T @ (p - y) + 0.1 * (a - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(a[0], 1e-3)), float(a[1])


def co_train(labelled: tuple[Rows, Rows], y: np.ndarray, pool: tuple[Rows, Rows], rounds: int = ROUNDS) -> Model:
    """Model of the labelled documents' views (content, metadata) and the pool's; every fourth labelled one only
    calibrates. Too few labels, or labels of one kind, give a model that says 0.5."""
    if len(y) < 8 or len(set(y.tolist())) < 2:
        return Model(np.zeros(CONTENTS), np.zeros(METAS))
    keep = np.arange(len(y)) % 4 == 3
    if len(set(y[~keep].tolist())) < 2 or len(set(y[keep].tolist())) < 2:
        keep = np.zeros(len(y), bool)
    good, n = y[~keep].mean(), len(pool[0])
    extra: list[dict[int, float]] = [{}, {}]

    def fitted(v: int) -> np.ndarray:
        more = sorted(extra[v])
        rows = labelled[v].take(np.flatnonzero(~keep)) + pool[v].take(more)
        return fit(Rows(rows, labelled[v].width), np.concatenate([y[~keep], [extra[v][i] for i in more]]))

    for _ in range(rounds):
        said = [pool[v].dot(fitted(v)) for v in (0, 1)]
        for v in (0, 1):
            free = np.array([i for i in range(n) if i not in extra[1 - v]], np.int64)
            ranked = free[np.argsort(said[v][free], kind="stable")]
            bad, fine = ranked[: int(SHARE * n * (1 - good))], ranked[max(0, len(ranked) - int(SHARE * n * good)) :]
            extra[1 - v] |= {int(i): 0.0 for i in bad} | {int(i): 1.0 for i in fine}
    model = Model(fitted(0), fitted(1))
    held = keep if keep.any() else ~keep
    for v, w in enumerate((model.content, model.metadata)):
        model.slopes[v], model.offsets[v] = calibrate(labelled[v].dot(w)[held], y[held])
    return model


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, y, at, x, metas): both views of each whole text, made where the text is; CONTENTS + METAS numbers at most."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = as_bytes(b.column(2))
        for i, j in slices(text):
            part = b.slice(i, j - i)
            texts = [t or b"" for t in text.slice(i, j - i).to_pylist()]
            at, x = zip(*map(content, texts))
            metas = [metadata(len(t), *r) for t, *r in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64())), pa.array(metas, pa.list_(pa.float64()))],
                ["doc_id", "y", "at", "x", "metas"],
            )

    return map_batches(rows.select(F.col("doc_id").cast("long"), "y", "text", "lang", "source"), run, "doc_id long, y double, at array<int>, x array<double>, metas array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from a bounded sample by a hash of doc_id: LABELLED documents with a label (0 or 1) and POOL without, each
    with its whole text.

    Documents whose crc32(doc_id as text) modulo 5 is 0 are held out. Conflicting labels of one document count as 0;
    of several rows with one doc_id the least (text, lang, source) is taken, nulls first. Null texts are empty, null
    lang and source the empty text; rows without a doc_id, labels other than 0 and 1 and labels of documents that
    aren't there are left out; other columns of either table are not read, whatever their names. Ties in the hash go
    to the smaller doc_id. Empty tables, or labels of one kind, give a model that says 0.5.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40))
    fits = crc_mod(F.col("doc_id"), 5) != 0
    n, total = known.count(), docs.count()
    chosen = known.filter(fits & (place < int((1 << 40) * min(1.0, 1.2 * LABELLED / max(1, n))))).orderBy(place, "doc_id").limit(LABELLED)
    pool = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & fits & (place < int((1 << 40) * min(1.0, 2 * POOL / max(1, total)))))
    pool = pool.distinct().join(known, "doc_id", "left_anti").orderBy(place, "doc_id").limit(POOL).withColumn("y", F.lit(None).cast("double"))
    ids = chosen.union(pool.select("doc_id", "y"))  # LABELLED + POOL rows at most
    own = docs.select("doc_id", *(F.col(c).cast("string") for c in ("text", "lang", "source")))
    one = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("row"))
    table = _features(one.select("doc_id", "y", "row.*")).orderBy(place, "doc_id").toArrow()
    y = table.column("y").to_numpy().astype(float)
    at, x, metas = (table.column(c).combine_chunks() for c in ("at", "x", "metas"))
    every = np.arange(METAS)

    def views(which: np.ndarray) -> tuple[Rows, Rows]:
        return Rows([(at[i].values.to_numpy().astype(np.int64), x[i].values.to_numpy()) for i in which.tolist()], CONTENTS), Rows([(every, metas[i].values.to_numpy()) for i in which.tolist()], METAS)

    has = ~np.isnan(y)
    return co_train(views(np.flatnonzero(has)), y[has], views(np.flatnonzero(~has)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, keep) of every whole text; keep where the score is 0.5 or more.

    Null and empty texts have no content features; null lang and source are values of their own. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = as_bytes(b.column(1))
        for i, j in slices(text):
            z = np.array([shared.value.odds(t or b"", k, s) for t, k, s in zip(text.slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i).to_pylist(), b.column(3).slice(i, j - i).to_pylist())])
            p = sigmoid(z.sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, (sigmoid(z[:, 0]), sigmoid(z[:, 1]), p, p >= 0.5))], ["doc_id", "content_score", "metadata_score", "score", "keep"])

    own = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source")))
    return map_batches(own, run, "doc_id long, content_score double, metadata_score double, score double, keep boolean")
