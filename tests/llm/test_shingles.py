"""The pipeline's near-dedup stage against all pairs of five-word shingle sets."""

import random

import pytest

import corpus_pipeline
from tracewell.llm import shingles, simhash

from .test_text_operators import classes


def plain(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited_texts():
    """Texts of new words, and chains of copies with a few words replaced: likenesses around 0.8."""
    rng = random.Random(8)
    new = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(25):
        text = [new() for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        out.append(" ".join(text))
        for _ in range(4):
            text = list(text)
            for _ in range(1 + len(text) // 60):
                text[rng.randrange(len(text))] = new()
            out.append(" ".join(text).title())
    rng.shuffle(out)
    return [*out, "", None, " \n"]


@pytest.mark.parametrize("many", [500, 3])
def test_near_dedup_stage_equals_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(shingles, "MANY", many)
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[7])], "doc_id long, text string")
    sets = {i: plain(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    want = classes(pairs, sets)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i in [*sets, 7] if want[i] == i) and got.count(None) == 1
    if many == 500:  # what three-word fingerprints leave of them
        assert simhash.near_dedup(docs).count() > len(got)


def test_near_dedup_stage_of_nothing(spark, empty, odd):
    assert corpus_pipeline.near_dedup(spark, empty, "").collect() == []
    assert corpus_pipeline.near_dedup(spark, odd, "").columns == odd.columns


def test_near_dedup_stage_links_fingerprints(spark):
    tail = lambda i: " ".join(f"t{i}x{k}" for k in range(30))
    texts = {i: "a b c " * 200 + tail(i) for i in (1, 2)} | {3: "d e f " * 200 + tail(3)}
    assert (simhash.fingerprint(texts[1].encode()) ^ simhash.fingerprint(texts[2].encode())).bit_count() <= simhash.BITS
    assert not alike(plain(texts[1]), plain(texts[2]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
