"""SimHash near-duplicates: fingerprints of word shingles, linked through a pigeonring filter.

Pigeonring: 64 bits form a ring of m = 4 segments of 16. If two fingerprints differ in at most 3 bits, some chain of
consecutive segments keeps every prefix of length l within l * 3 / 4 differences: none in its first segment, at most
one in its first two. Both are part of the key on which candidates meet, so that a key holds 32 bits; only then
follows the full Hamming check. Within a key a spanning forest of links is built, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, map_iter, spread_join, stored
from .components import connected_components, spanning_forest

WORDS, BITS, SEGMENTS, SEED = 3, 3, 4, 42
#: Fingerprints of a key that are compared in one go; more are dealt to pairs of blocks.
MANY = 20_000
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text: bit set where over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    w = (text or b"").lower().split()  # of ASCII letters and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        grams: Iterator = iter([b" ".join(w)])
        n = 1
    else:
        grams, n = map(b" ".join, zip(*(w[i:] for i in range(words)))), len(w) - words + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        part = h[i : i + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every document."""

    def run(b: pa.RecordBatch):
        fps = np.fromiter((fingerprint(x.as_py(), words) for x in as_bytes(b.column(1))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _keys(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Chain keys of distinct fingerprints: for each of 4 starts the start's segment and the next one, as it is and
    with each of its zero bits set; two next segments that differ in one bit meet on the one that has it set."""
    fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    keys, fps = [], []
    for i in range(SEGMENTS):
        seg = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        nxt = (fp >> np.uint64(16 * ((i + 1) % SEGMENTS))) & np.uint64(0xFFFF)
        key = np.uint64(i << 32) | (seg << np.uint64(16)) | nxt
        keys.append(key)
        fps.append(fp)
        for bit in range(16):
            unset = (nxt >> np.uint64(bit)) & np.uint64(1) == 0
            keys.append(key[unset] | np.uint64(1 << bit))
            fps.append(fp[unset])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps)], ["key", "fp"])


def _links(bits: int):
    """Rows sorted by key to links of a spanning forest within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def of(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(k)) + 1
            a: list = []
            b: list = []
            starts, ends = np.r_[0, cut], np.r_[cut, len(k)]
            many = ends - starts > 1
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                for x, found in spanning_forest(np.unique(f[s:e]), bits):
                    a.append(np.full(len(found), x, np.uint64))
                    b.append(found)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])  # the last key may go on in the next batch
            if last:
                yield from of(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        if len(rest_k):
            yield from of(rest_k, rest_f)

    return run


def _split(keyed: DataFrame, often: DataFrame) -> DataFrame:
    """Keys with over MANY fingerprints (often: key, n) as one for each pair of blocks of them: every two fingerprints
    still meet on some key, and no key has more than about twice MANY. Keys are hashes; where two collide, candidates
    are added, and the Hamming check sorts them out."""
    found = keyed.join(often, "key", "left")
    blocks = F.ceil(F.col("n") / MANY).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), blocks).cast("int")
    salted = found.filter("n is not null").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    salted = salted.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    return found.filter("n is null").select("key", "fp").union(salted)


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) links that span the same components as all pairs of distinct fingerprints (fp) at `bits` or fewer bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the ring of four segments proves chains for 3 bits at most")
    keyed = map_batches(fps.select("fp").distinct(), _keys, "key long, fp long")
    often = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MANY))
    if not often.isEmpty():
        keyed = _split(keyed, often)
    return map_iter(keyed.repartition("key").sortWithinPartitions("key"), _links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked, over any number of links, share the
    smallest doc_id among them.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay repeated. A null doc_id
    has its row, but names no component unless all of the component's are null. Other columns are ignored.
    """
    own = stored(fingerprints(docs, words))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(links(own, bits)).toDF("fp", "comp")
    named = stored(classes.join(comps, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least"))
    least = stored(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    ids = stored(spread_join(named, least, ["comp"]).select("fp", "component_id"))
    return spread_join(own, ids, ["fp"]).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """docs without those that are not the first (smallest doc_id) of their component; all columns are kept.

    Of repeated rows with the first doc_id, and of a component without any doc_id, every row stays.
    """
    gone = near_duplicates(docs, words, bits).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def hexed(fp):
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
