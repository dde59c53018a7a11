"""Mixing sources to target weights: each document floor(rate) times, and once more with the rate's fraction as probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Sources whose rates are broadcast (a row of some 50 bytes each).
MANY = 100_000


def n_words(text: Column) -> Column:
    """Number of words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) per document or group to (source, source_size, target).

    Sources in code point order, null last, have the weights in turn. share times all sizes is dealt by weight; a
    target stops at `most` times its source's size, and the excess is dealt again. In closed form: in ascending order
    of cap over weight, sources are at their cap as long as dealing the rest by weight would exceed it.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everywhere = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        own.withColumn("place", F.row_number().over(named))
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), True).over(everywhere))
    )
    return ranked.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def unit(key: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for a key: the first 32 bits of its MD5 with the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def _copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), and one more with the fraction as probability."""
    return (F.floor(rate) + (unit(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def _rated(docs: DataFrame, to: DataFrame, source: str) -> DataFrame:
    """docs joined with one row per source. Up to MANY sources are counted and broadcast, so that neither texts nor a hot
    source are shuffled; more of them are joined by a shuffle whose skewed partitions Spark splits."""
    to = stored(to)
    same = docs["source"].eqNullSafe(to[source])
    return docs.join(F.broadcast(to) if to.count() <= MANY else to, same)


def rates(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs' doc_id and source with size, source_size, target, copies and taken (words of all copies).

    The rate of a source is target over size; a source without words has rate 0. Equal doc_ids draw equal numbers, so
    that reruns and repeated rows agree. A null source is a source; a null doc_id draws as the empty text; null and
    empty texts have size 0. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    to = targets(sized, weights, share, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = _rated(sized, to, "_source").drop("_source").withColumn("copies", _copies(rate, F.col("doc_id"), seed))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it: rows taken 0 times go, the others are repeated.

    Null sources are one source, the last; null and empty texts have size 0, and rows of a source whose size is 0 go.
    The copies of a document follow from its doc_id (null: the empty text), so that rows of one doc_id are taken equally
    often and reruns agree. All columns are kept, whatever their names; an empty table gives an empty one.
    """
    source, rate, copies = (fresh(docs, c) for c in ("_source", "_rate", "_copies"))
    to = targets(docs.select("source", n_words(F.col("text")).alias("size")), **{k: v for k, v in how.items() if k != "seed"})
    to = to.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    times = _copies(F.col(rate), F.col("doc_id"), how.get("seed", 7))
    often = _rated(docs, to, source).withColumn(copies, times).filter(F.col(copies) > 0)
    return often.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
