"""Nearest neighbours, LM scoring, the quality classifier and the pipeline against plain versions and held-out rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import ann, bpe, langid, line_dedup, lm, mixing, quality, simhash

from .test_text_operators import classes, plain_fingerprint, plain_line_dedup

# 3


def plain_nearest(rows, asked, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) in (15, 64) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked & set(ok):
        scores = sorted((-float((v * ok[q]).sum() / np.sqrt((v * v).sum()) / np.sqrt((ok[q] ** 2).sum())), i) for i, v in ok.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 15)).astype(np.float32)
    x[100:160] = x[99]  # many equal vectors: ties to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 15), (1002, [float("nan"), *[1.0] * 14]), (1003, [None, *[1.0] * 14]), (1004, [float("inf")] * 15), (None, [1.0] * 15), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, codes string")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 10 = 0"), rows=128).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = plain_nearest(rows, {i for i in range(0, 1010, 10)}, 5)
    assert set(got) == set(want)
    assert got[100] == [(i, pytest.approx(1.0)) for i in (99, 101, 102, 103, 104)]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want if not 99 <= q < 160)
    assert hits >= 0.95 * sum(len(want[q]) for q in want if not 99 <= q < 160)
    for q in want:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 5


def exact(ids, x, asked, k):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in asked:
        scores = u @ u[q]
        scores[q] = -np.inf
        out[int(ids[q])] = set(ids[np.argpartition(-scores, k)[:k]].tolist())
    return out


def test_recall_with_whole_blocks(spark):
    """20,000 vectors in blocks of 4,096, of each of which 64 are ranked again, as the registered query does."""
    rng = np.random.default_rng(8)
    crowds = rng.normal(size=(300, 64))
    x = (crowds[rng.integers(0, 300, 20_000)] + 0.6 * rng.normal(size=(20_000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(x)], "vec_id long, embedding array<float>, v string, leaf string").coalesce(2)
    got = collections.defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(np.arange(20_000), x.astype(float), range(0, 20_000, 50), 5)
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_recall_of_the_registered_query(spark):
    import pyarrow.parquet as pq

    from tracewell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    ids, x = np.array(rows["vec_id"]), np.array(rows["embedding"], float)
    want = exact(ids, x, np.flatnonzero(ids % 50 == 0), 5)
    got = collections.defaultdict(set)
    for r in QUERIES["op3_nearest"](spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_parts_of_the_queries_and_the_exact_way(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(ann, "ASKED", 8 * 8 * 20)  # 20 queries at a time
    got = collections.defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 10 = 0"), again=100, rows=100).collect():
        got[r.query_id].add(r.vec_id)
    assert got == exact(np.arange(600), x, range(0, 600, 10), 5)


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(one, one.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.search(one.limit(0), one).collect() == [] and ann.search(one, one.limit(0)).collect() == []


def test_anisotropic_codes_keep_large_products():
    rng = np.random.default_rng(1)
    x = ann._unit(rng.normal(size=(2000, 64)))
    q = ann.learn(x)
    leaf, multiple, scale, codes = q.encode(x)
    of = lambda codes: multiple[:, None] * q.coarse[leaf] + scale[:, None] * q.centres[np.arange(len(q.centres)), codes].reshape(len(x), -1)
    u = q.split(q.parts(x)[3])
    plain = np.stack([((u[:, k, None] - q.centres[k]) ** 2).sum(-1).argmin(1) for k in range(len(q.centres))], 1)
    along = lambda y: ((x - y) * x).sum(1) ** 2
    assert along(of(codes)).mean() < along(of(plain)).mean()
    assert np.allclose(q.scores(x[:5], leaf, multiple, scale, ann.packed(codes).T), x[:5] @ of(codes).T, atol=1e-5)


def test_crowds_of_nearly_equal_vectors():
    rng = np.random.default_rng(2)
    crowd = rng.normal(size=64) + 0.05 * rng.normal(size=(1500, 64))
    v = np.concatenate([crowd, np.repeat(crowd[:1], 300, 0), rng.normal(size=(1500, 64))])
    x, ids = ann._unit(v), np.arange(len(v))
    q = ann.learn(x)
    leaf, multiple, scale, codes = q.encode(x)
    asked = np.arange(0, len(v), 50)
    found = ann.scan(q, (ids, v, leaf, multiple, scale, ann.packed(codes)), asked, v[asked], 5, ann.AGAIN)
    want = plain_nearest(list(enumerate(v)), set(asked.tolist()), 5)
    got = collections.defaultdict(set)
    for a, b, _ in zip(*found):
        got[a].add(b)
    assert sum(len(got[a] & {i for i, _ in want[a]}) for a in want) >= 0.95 * 5 * len(want)


# 7


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_lm_score(spark, sf, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for df, rows in ((docs, rows), (odd, [(i, t) for i, t, *_ in odd_rows])):
        got = lm.score(df).collect()
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
        n, v = sum(counts.values()), len(counts)
        want = collections.Counter()
        for i, t in rows:
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
            want[(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 5))] += 1
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
        if df is docs:
            out = [r for r in got if r.held_out]
            assert sum(r.score for r in out) > sum(r.base_score for r in out)
    nothing = lm.score(empty)
    assert nothing.collect() == []


def test_counts_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 40)  # many buckets
    docs = spark.createDataFrame([(i, "a a a b b c " + ("zz" if i % 2 else "yy")) for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    counts = collections.Counter(w for r in got.values() if not r.held_out for w in tokens("a a a b b c " + ("zz" if r.doc_id % 2 else "yy")))
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens("a a a b b c " + ("zz" if i % 2 else "yy"))))
        assert r.n_known == 8


# 8


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and sum(r.keep == (r.quality == 1) for r in held) / len(held) > 0.9
    assert sum(r.keep for r in held if r.quality == 1) / sum(r.quality == 1 for r in held) > 0.95
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(empty, model).collect() == []
    none = quality.learn(empty, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_calibration_and_rows():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < quality.sigmoid(3 * z - 1)).astype(float)
    slope, offset = quality.calibrate(z, y)
    assert slope == pytest.approx(3, abs=0.4) and offset == pytest.approx(-1, abs=0.3)
    x = quality.Rows([(np.array([0, 2]), np.array([1.0, 2.0])), (np.array([], int), np.array([]))], 3)
    assert x.dot(np.array([1.0, 5.0, 1.0])).tolist() == [3.0, 0.0] and x.back(np.array([2.0, 1.0])).tolist() == [2.0, 0.0, 4.0]


# the pipeline


def plain_pipeline(docs):
    """Rows (doc_id, n_tokens, decoded_sha256) of the stages one after the other, on plain lists."""
    model = langid.learn(langid.sample(docs))
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r in rows if model.predict([(r["text"] or "").encode()])[0][0] != "und"]
    cut = plain_line_dedup([(r["doc_id"], r["text"]) for r in kept], line_dedup.LEAST_WORDS)
    for r in kept:
        if r["doc_id"] is not None:
            r["text"] = cut.get(r["doc_id"], r["text"])
    fps = {id(r): plain_fingerprint(r["text"]) for r in kept}
    root = classes([(a, b) for a in set(fps.values()) for b in set(fps.values()) if a < b and (a ^ b).bit_count() <= simhash.BITS], set(fps.values()))
    least = {}
    for r in kept:
        k = root[fps[id(r)]]
        if r["doc_id"] is not None:
            least[k] = min(r["doc_id"], least.get(k, r["doc_id"]))
    kept = [r for r in kept if r["doc_id"] is None or least[root[fps[id(r)]]] == r["doc_id"]]
    spark = docs.sparkSession
    again = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in kept], "doc_id long, text string, source string")
    copies = collections.defaultdict(list)
    for r in mixing.rates(again).collect():
        copies[(r.doc_id, r.source)].append(r.copies)
    enc, out = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    for r in kept:
        text = (r["text"] or "").encode()
        n = len(next(enc.encode([text]))) // 4
        out += [(r["doc_id"], n, hashlib.sha256(text).hexdigest())] * copies[(r["doc_id"], r["source"])][0]
    return collections.Counter(out)


def small(spark, sf, n):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(n)
    return docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("lines_removed", F.lit("y"))


def run_stages(docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = out.sparkSession.createDataFrame(out.collect(), out.schema)
    return collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](docs.sparkSession, docs, "").collect())


def test_pipeline(spark, sf):
    docs = small(spark, sf, 90)
    assert run_stages(docs) == plain_pipeline(docs)


def test_pipeline_of_odd_rows(spark, odd):
    assert run_stages(odd) == plain_pipeline(odd)


def test_pipeline_of_nothing(spark, empty):
    assert run_stages(empty) == collections.Counter()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_registered(spark, sf):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    docs = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(4, 0, 0)] * 4
    assert all(r.base_score == pytest.approx(0) and r.score < 0 for r in got)
