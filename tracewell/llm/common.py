"""Helpers that the operators share: scratch tables in the shared folder, and Arrow batches as bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import dropped, shared_dir, stored  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as bytes, without decoding; null stays null."""
    return column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column


def slices(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `most` bytes each; a longer single text has a range of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: A key that has more than this part of all rows is hot.
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the row of table (one at most for each key) that has their keys, which aren't null.

    A key with more than a HOTth of all rows (less than HOT keys, whatever the input) goes to the rows by broadcast, so
    that no task has all rows of it; other rows go to their keys. rows are read three times, table twice: stored ones.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))  # counted before the shuffle
    hot = stored(counts.filter(F.col("_n") > rows.count() // HOT).select(*keys))
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))


#: Bytes of an Arrow batch, so that long texts don't fill a worker's memory ten thousand at a time.
BATCH = 4 << 20


def release() -> None:
    """Gives freed memory back to the system; workers live on and would keep it for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_iter(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of BATCH bytes (a setting of the session from then on)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(batches):
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """The same with a function of one batch that has rows."""
    return map_iter(df, lambda batches: (x for b in batches if b.num_rows for x in f(b)), schema)
