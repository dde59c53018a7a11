"""Quality is learned from whole texts, however long."""

import zlib

from tracewell.llm import quality


def test_what_stands_late_in_a_text_is_learned(spark):
    plain = "some plain words of no kind " * 400  # over 8,000 characters
    rows = [(i, plain + ("fine good kind " if i % 2 else "junk spam bad ") * 40, "en", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    held = [r for r in quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all(r.keep == (r.doc_id % 2 == 1) for r in held)


def test_features_are_those_of_scoring(spark, odd):
    from pyspark.sql import functions as F

    rows = {(r.doc_id, len(r.at)): r for r in quality._features(odd.withColumn("y", F.lit(0.0))).collect()}
    for r in odd.collect():
        k, x = quality.content((r.text or "").encode())
        got = rows[(r.doc_id, len(k))]
        assert got.at == k.tolist() and got.x == x.tolist()
        assert got.metas == quality.metadata(len((r.text or "").encode()), r.lang, r.source).tolist()


def test_repeated_ids_and_clashing_names(spark, odd, odd_rows):
    from pyspark.sql import functions as F

    docs = odd.withColumn("y", F.lit("y")).withColumn("quality", F.lit("q")).withColumn("metas", F.lit("m"))
    ids = [1, 2, 4, 5, 6, 7, 8, 9, None, 77]
    labels = spark.createDataFrame([(i, k % 2, "x") for k, i in enumerate(ids)] + [(2, 0, "x"), (8, 5, "x")], "doc_id long, quality int, y string")
    more = spark.createDataFrame([(i, f"words {i} of a text", "en", "a", 9) for i in range(100, 140)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    labels = labels.union(spark.createDataFrame([(i, i % 2, "x") for i in range(100, 140)], labels.schema))
    a, b = (quality.learn(x, labels) for x in (docs, docs.repartition(5).orderBy(F.desc("text"))))
    assert (a.content == b.content).all() and (a.metadata == b.metadata).all() and a.slopes == b.slopes and a.content.any()
    got = quality.score(docs, a).collect()
    assert len(got) == len(odd_rows) + 40
    empty = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_scores_equal_a_plain_version(spark, odd, odd_rows):
    """Log odds of both views, calibrated and added, word by word."""
    import collections
    import math
    import random

    rng = random.Random(2)
    model = quality.Model(*([rng.uniform(-1, 1) for _ in range(n)] for n in (quality.CONTENTS, quality.METAS)), [1.5, 0.5], [0.1, -0.2])
    model.content, model.metadata = (quality.np.array(x) for x in (model.content, model.metadata))
    half = quality.WIDTH // 2
    want = collections.Counter()
    for i, t, lang, source in odd_rows:
        text = (t or "").encode()
        words, x = collections.Counter(text.split()), [0.0] * quality.CONTENTS
        for w, n in words.items():
            x[zlib.crc32(w) % half] += math.log1p(n)
            x[half + zlib.crc32(w[-2:]) % half] += n
        for a, b in ((0, half), (half, 2 * half)):
            norm = math.sqrt(sum(v * v for v in x[a:b])) or 1.0
            x[a:b] = [v / norm for v in x[a:b]]
        if words:
            share = [sum(quality.BYTE_KIND[c] == k for c in text) / len(text) for k in range(8)]
            x[2 * half :] = [4 * s for s in share] + [math.sqrt(share[k]) for k in (1, 3, 6, 7)]
        z = 1.5 * sum(v * w for v, w in zip(x, model.content)) + 0.1, 0.5 * sum(v * w for v, w in zip(quality.metadata(len(text), lang, source), model.metadata)) - 0.2
        want[(i, *(round(1 / (1 + math.exp(-v)), 9) for v in (*z, sum(z))))] += 1
    got = collections.Counter((r.doc_id, *(round(v, 9) for v in (r.content_score, r.metadata_score, r.score))) for r in quality.score(odd, model).collect())
    assert got == want
