import random

import pytest

#: Columns whose names the operators use themselves.
CLASH = ["fp", "key", "score", "lang_pred", "lines_removed", "_doc", "_spans", "_rate", "_source", "_copies", "_gone", "size", "row", "bucket"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    """documents of (doc_id, text, lang, source), with more columns whose names clash."""
    full = [(i, t, lang, source, None if t is None else len(t), *(f"x{i}" for _ in CLASH)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, equal texts."""
    rng = random.Random(11)
    words = ["the", "of", "Lorem", "ipsum", "naïve", "don't", "x1", "...", "été", "一二"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body = "\n".join(text(30) for _ in range(6))
    rows = [(1, body, "en", "a"), (2, body, "en", "b"), (3, None, None, None), (4, "", "fr", "a"), (5, text(4000), "en", None), (6, "word", "de", "b"), (7, "\n\n \t", "de", "a")]
    rows += [(8, body + "\n" + text(9), "en", "a"), (9, text(40) + "\n" + body.split("\n")[2] + "\n" + body.split("\n")[3], "en", "c"), (1, body, "en", "a"), (None, text(60), None, "c")]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture
def empty(spark):
    return table(spark, [])
