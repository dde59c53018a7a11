"""The operators' queries over the tables of a folder, and SQL for those that SQL can express.

Each applies its operator to the whole table with the operator's own parameters; what null, empty, long, tied and
repeated rows, empty tables and clashing names give is said there. Columns of the table that an operator doesn't name
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, line_dedup, lm, mixing, quality, simhash, spotsigs, token_counts
from .common import crc_mod, fresh

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text (null stays null), and the number of lines that went."""
    docs = _documents(spark, sf_dir)
    removed = F.col(fresh(docs, "lines_removed")).alias("lines_removed")
    return line_dedup.line_dedup(docs).select("doc_id", "text", removed)


def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_line_dedup, whose SQL knows runs of 50 words of whole lines only, with repeated passages inside lines and
    repeated lines of few words deleted as well."""
    docs = _documents(spark, sf_dir)
    removed = F.col(fresh(docs, "lines_removed")).alias("lines_removed")
    return line_dedup.line_dedup(docs, line_dedup.SHORT_WORDS, passage=line_dedup.PASSAGE_WORDS).select("doc_id", "text", removed)


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Every document's tokens, its file and its place there; null and empty texts have 0."""
    return token_counts.document_counts(_documents(spark, sf_dir), path, end_id=50_256)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 5 of each 50th vector; vectors that can't be compared take no part, ties go to the smaller id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and what the mix takes of it; null is the last source."""
    return mixing.rates(_documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null and empty texts have fingerprint 0 and are linked like others."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; texts without a letter, null ones too, are und with score 0."""
    docs = _documents(spark, sf_dir)
    model = langid.learn(langid.sample(docs))
    return langid.identify(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; a null text is an empty one, with the end as its one token."""
    return lm.score(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by both views and together; null and empty texts are judged by their metadata."""
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likenesses; null texts are empty ones."""
    return spotsigs.edited_likeness(_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Every document's number of tokens and digests of its ids and of what they decode to; null texts are empty ones."""
    return bpe.digests(_documents(spark, sf_dir), path)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_line_dedup, op1_passage_dedup, op2_token_counts, op3_nearest, op4_mixing, op5_simhash, op6_language_id, op7_lm_score, op8_quality, op9_spotsigs, op10_byte_bpe)}
SQL: dict[str, str] = {
    "op1_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
        w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
        u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
        p AS (SELECT a.doc_id, a.i, b.i AS j FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50),
        s AS (SELECT doc_id, i, min(j) AS j FROM p GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM p GROUP BY doc_id, j),
        c AS (SELECT s.doc_id, s.i, s.j, array_to_string(list_slice(d.lines, s.i, s.j), chr(10)) AS content FROM s JOIN d ON s.doc_id = d.doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS n FROM c),
        gone AS (SELECT DISTINCT r.doc_id, u.i FROM r JOIN u ON u.doc_id = r.doc_id AND u.i BETWEEN r.i AND r.j WHERE r.n > 1),
        k AS (SELECT u.doc_id, string_agg(CASE WHEN g.i IS NULL THEN u.line END, chr(10) ORDER BY u.i) AS text, count(g.i) AS lines_removed
            FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.lines_removed, 0) AS lines_removed
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op4_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
        w AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM n),
        r AS (SELECT *, cap / weight AS ratio, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        x AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
        t AS (SELECT source, source_size, least(cap, x.level * weight) AS target FROM l, x),
        m AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
            CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS unit
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM m)
        SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM c""",
}
