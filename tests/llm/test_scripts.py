"""Language ID over many scripts and more than 64 languages."""

import random

import numpy as np

from tracewell.llm import langid


def words_in(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def test_many_scripts_and_languages(spark):
    rng = random.Random(4)
    scripts = [range(0x61, 0x7B), range(0x3B1, 0x3CA), range(0x430, 0x450), range(0x5D0, 0x5EB), range(0x627, 0x63B), range(0xE01, 0xE2F), range(0xAC00, 0xAF00), range(0x4E00, 0x5600)]
    own = {f"l{k:02}": words_in(rng, [chr(c) for c in scripts[k % len(scripts)]], 40) for k in range(80)}
    text = lambda k: " ".join(rng.choice(own[k]) for _ in range(60))
    rows = [(i, f"l{i % 80:02}", text(f"l{i % 80:02}")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples = langid.sample(docs)
    model = langid.learn(samples)
    assert set(samples) == set(own)
    assert model.predict([text(k).encode() for k in own])[0] == list(own)


def test_letters_keep_their_identity():
    points = np.flatnonzero(langid._tables()[1])
    points = points[langid._tables()[0][points] == points].astype(np.int32)
    alphabet = langid.Alphabet(points)
    for some in (points[:2000], points[-2000:]):
        spelled = {alphabet.encode(some[i : i + 1]).tobytes() for i in range(len(some))}
        assert len(spelled) == len(some)
        assert b"".join(alphabet.encode(some[i : i + 1]).tobytes() for i in range(len(some))) == alphabet.encode(some).tobytes()
        assert max(max(x) for x in spelled) < langid.WIDTH


def test_all_documents_are_learned_from():
    docs = [np.full(n, i + 2, np.uint8) for i, n in enumerate([5, 100, 100, 1])]
    got = langid._evenly(docs, 60)
    assert len(got) == 60 and set(got.tolist()) == {2, 3, 4, 5}
    assert len(langid._evenly(docs, 1000)) == 206
