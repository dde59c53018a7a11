"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and byte-level BPE, one after the other.

Each stage gets the whole table that its predecessor kept; run() writes every stage's table to the shared folder and
reads it again, so that a lost executor costs at most one stage.

For all stages: an empty table gives an empty one; repeated rows are rows of their own; further columns stay as they are,
whatever their names (helpers take names that are free); texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, langid, line_dedup, mixing, shingles, simhash
from tracewell.llm.common import fresh, stored

#: SQL has neither the automata nor the merges; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; und (null and empty texts, those without a letter, and all if nothing could be
    learned) goes. lang becomes the prediction; null lang is not learned from; equal scores go to the language that most
    documents have. A null doc_id takes part."""
    model = langid.learn(langid.sample(docs))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.with_language(docs, model, lang, score).filter(F.col(lang) != langid.UNKNOWN)
    return found.withColumn("lang", F.col(lang)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occurred before; n_chars follows the text (null for a null one). A text
    of which nothing is left stays as an empty one; rows without a doc_id stay as they are."""
    cut = line_dedup.line_dedup(docs, removed_as=fresh(docs, "lines_removed"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id) of each group of near duplicates: SimHash fingerprints of three-word shingles
    that differ in at most 3 bits, or five-word shingles with a Jaccard likeness of 0.8 or more. Texts without a word, null ones too, are alike; rows that repeat the first doc_id stay, and rows without
    a doc_id."""
    return shingles.near_dedup(docs, bits=simhash.BITS).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null is a source of its own, the last one; null and empty texts have size
    0, and a source of size 0 is not taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text that they decode to; null texts are empty ones,
    with 0 tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
