"""Token counts of flat token files: a vectorised search for end-of-document ids, block by block.

A flat file is little-endian ids, document after document, each ended by the end-of-document id; there is no index.
Blocks of a file are searched on their own. A block tells the lengths of documents that lie inside it, how many ids
come before its first separator and how many after its last. A prefix scan over the blocks' summaries carries open
documents from block to block; it runs in spans of SPAN blocks and then over the spans, so that a file of any size is
never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _each, tokenizer
from .common import map_iter, stored

#: Ids of a block, and blocks of a span of the prefix scan.
BLOCK, SPAN = 1 << 18, 1 << 10


def read_flat(spark: SparkSession, path: str, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, block, ids binary) of flat files (one glob or folder), each below 2 GB; ids as they are in the file."""
    size = np.dtype(dtype).itemsize * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(data.as_buffer())
                for i in range(0, max(1, len(view)), size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // size]), pa.array([bytes(view[i : i + size])], pa.binary())], ["file", "block", "ids"])

    return map_iter(spark.read.format("binaryFile").load(path).select("path", "content"), run, "file string, block long, ids binary")


def summaries(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, block, size, head, inside array<long>, last) of each block: its ids, those before its first separator,
    lengths between separators, place of its last separator. Without a separator head and last are null. A null block
    counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2):
                ids = np.frombuffer(data.as_py() or b"", dtype)
                at = np.flatnonzero(ids == end_id)
                rows.append((len(ids), int(at[0]), np.diff(at) - 1, int(at[-1])) if len(at) else (len(ids), None, np.empty(0, np.int64), None))
            if rows:
                size, head, inside, last = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(head, pa.int64()), pa.array(inside, pa.list_(pa.int64())), pa.array(last, pa.int64())], ["file", "block", "size", "head", "inside", "last"])

    return map_iter(blocks.select("file", F.col("block").cast("long"), "ids"), run, "file string, block long, size long, head long, inside array<long>, last long")


def _before(df: DataFrame, by: list[str], order: str, into: str) -> DataFrame:
    """Adds what lies before each row: {into}at (ids), {into}ends (separators), {into}last (place of the last one)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(f"{into}at", F.coalesce(F.sum("size").over(w), F.lit(0)))
    df = df.withColumn(f"{into}ends", F.coalesce(F.sum("ends").over(w), F.lit(0)))
    return df.withColumn(f"{into}last", F.max(F.col(f"{into}at") + F.col("last")).over(w))


def counts(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of every document, ordinals from 0 in file order; separators aren't counted.

    Ids after a file's last separator are a last document without an end, if there are any. An empty file has no
    documents; two separators in a row have an empty one between them. Blocks (file, block, ids) of a file have
    distinct numbers in file order; other columns are ignored.
    """
    ends = F.when(F.col("last").isNull(), 0).otherwise(F.size("inside") + 1).cast("long")
    own = stored(summaries(blocks, end_id, dtype).withColumn("ends", ends).withColumn("span", F.expr(f"block div {SPAN}")))
    inner = _before(own, ["file", "span"], "block", "b_")
    total = inner.groupBy("file", "span").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("b_at") + F.col("last")).alias("last"))
    outer = _before(total, ["file"], "span", "s_")
    at = inner.join(outer.select("file", "span", "s_at", "s_ends", "s_last"), ["file", "span"])
    last = F.coalesce(F.col("s_at") + F.col("b_last"), F.col("s_last"), F.lit(-1))  # the last separator before the block
    carried = F.col("s_at") + F.col("b_at") - last - 1  # ids of the document that is open where the block begins
    closed = at.filter("ends > 0").select("file", (F.col("s_ends") + F.col("b_ends")).alias("from"), F.posexplode(F.concat(F.array(carried + F.col("head")), "inside")))
    whole = outer.groupBy("file").agg(F.sum("size").alias("size"), F.sum("ends").alias("ordinal"), F.max(F.col("s_at") + F.col("last")).alias("last"))
    opened = whole.withColumn("n_tokens", F.col("size") - F.coalesce("last", F.lit(-1)) - 1).filter("n_tokens > 0")
    return closed.select("file", (F.col("from") + F.col("pos")).alias("ordinal"), F.col("col").alias("n_tokens")).union(opened.select("file", "ordinal", "n_tokens"))


def flat_files(docs: DataFrame, path: str, end_id: int, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """Token files of docs (doc_id, text), one per task, in blocks: (file, block, ids binary, first, doc_ids).

    doc_ids names the documents that begin in the block, first the number of those before. They are the writer's own
    list, by which its caller finds the documents again; counts() doesn't read it. A null text is an empty document.
    Ids that dtype can't hold are an error.
    """
    most = np.iinfo(dtype).max
    if end_id > most:
        raise ValueError(f"{dtype} can't hold the id {end_id}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number, first, ids, doc_ids = f"tokens-{TaskContext.get().partitionId():06d}", 0, 0, bytearray(), []
        end, size = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize * block

        def out(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number]), pa.array([data], pa.binary()), pa.array([first]), pa.array([doc_ids], pa.list_(pa.int64()))], ["file", "block", "ids", "first", "doc_ids"])

        for b in batches:
            for keys, blobs in _each(b, path):
                for k, x in zip(keys.to_pylist(), blobs):
                    doc_ids.append(k)
                    own = np.frombuffer(x, "<u4")
                    if len(own) and own.max() > most:
                        raise ValueError(f"{dtype} can't hold the id {own.max()}")
                    ids += own.astype(dtype).tobytes() + end
                    while len(ids) >= size:
                        yield out(bytes(ids[:size]))
                        del ids[:size]
                        number, first, doc_ids = number + 1, first + len(doc_ids), []
        if ids or doc_ids:
            yield out(bytes(ids))

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_iter(own, run, "file string, block long, ids binary, first long, doc_ids array<long>")


def document_counts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens): writes docs' token files to the shared folder and counts in them.

    Null and empty texts have 0 tokens; repeated rows are documents of their own; an empty table gives no rows. Ids
    take two bytes, or four if the vocabulary or the end needs them.
    """
    dtype = "<u2" if max(end_id, *tokenizer(path).ranks.values()) < 1 << 16 else "<u4"
    blocks = stored(flat_files(docs, path, end_id, dtype=dtype), compression="zstd")
    names = blocks.select("file", "first", F.posexplode("doc_ids")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), F.col("col").alias("doc_id"))
    return names.join(counts(blocks, end_id, dtype), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
