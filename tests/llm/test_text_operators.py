"""Line dedup, SimHash, mixing, language ID, BPE, token counts and SpotSigs against plain versions."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import bpe, components, langid, line_dedup, mixing, simhash, spotsigs, token_counts
from tracewell.llm.queries import QUERIES

from .conftest import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tokenizer(PATH).ranks, special_tokens={})


# 1


def plain_line_dedup(rows, least):
    """Lines in any run of `least` words that began at an earlier place, by trying all runs."""
    first = {}
    docs = sorted({(i, t) for i, t, *_ in rows if i is not None and t})
    for i, t in docs:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                first.setdefault(tuple(lines[a:b]), (i, a))
    out = {}
    for i, t in docs:
        lines = t.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.encode().split()) for x in lines[a:b]) >= least and first[tuple(lines[a:b])] < (i, a):
                    gone |= set(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_all_runs(spark, odd, odd_rows):
    got = line_dedup.line_dedup(odd, removed_as="n_removed").collect()
    assert line_dedup.line_dedup(odd).columns == [*odd.columns, "_lines_removed"]
    want = plain_line_dedup(odd_rows, line_dedup.LEAST_WORDS)
    assert len(got) == len(odd_rows) and got[0]._doc is not None and got[0].lines_removed is not None
    for r in got:
        assert r.doc_id is None or r.text == want.get(r.doc_id, r.text)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].text == "" and by_id[2].n_removed == 6 and by_id[1].n_removed == 0 and by_id[3].text is None


def test_line_dedup_random(spark):
    rng = random.Random(5)
    for least in (3, 7):
        rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "", "d d d d", "e"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
        want = plain_line_dedup(rows, least)
        assert got == {i: want.get(i, t) for i, t in rows}


def test_line_dedup_of_one_id_with_different_texts(spark):
    body = "\n".join(f"line {k} of the text that is repeated in full" for k in range(8))
    own = "keep0\nkeep1\nkeep2\nkeep3\nunique line that never occurred before"
    rows = [(1, body), (2, body), (2, own), (2, "short"), (2, own), (3, own + "\n" + body), (None, body)]
    got = sorted((r.doc_id or 0, r.text, r.lines_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, body, 0), (2, "", 8), (2, own, 0), (2, "short", 0), (2, own, 0), (3, own, 8), (0, body, 0)])
    # one id, two texts that share a run: the text with the smaller hash is the first
    rows = [(7, body + "\na"), (7, body + "\nb")]
    got = [r.lines_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [0, 8]


def test_line_dedup_query_on_clashing_columns(spark, odd, odd_rows, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op1_line_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lines_removed"] and got.count() == len(odd_rows)
    assert {r.doc_id: r.lines_removed for r in got.collect()}[2] == 6


def test_windows_and_their_kept_lines():
    rng = random.Random(9)
    for _ in range(2000):
        words, least = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(rng.randrange(1, 14))], rng.choice([1, 3, 7, 12])
        n = len(words)
        runs = [(i, j) for i in range(n) for j in range(i, n) if sum(words[i : j + 1]) >= least]
        want = {(i, min(j for a, j in runs if a == i)) for i, _ in runs} | {(max(i for i, b in runs if b == j), j) for _, j in runs}
        got = line_dedup.windows(words, least)
        assert sorted(got) == sorted(want)
        hashes = [rng.randrange(5) for _ in words]
        for (i, j), m in zip(got, line_dedup.kept(hashes, got)):
            assert i <= m <= j and all(hashes[m] < h or (hashes[m] == h and x <= m) for x, h in enumerate(hashes[i : j + 1], i))


def test_line_dedup_of_many_blank_lines(spark):
    run = "\n" * 100_000 + " ".join(f"w{k}" for k in range(60))
    rows = [(1, run), (2, "x\n" + run), (3, "\n" * 100_000)]
    started = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - started < 60
    assert got[1].lines_removed == 0 and got[2].text == "x" and got[3].lines_removed == 0


def test_hot_lines_go_by_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a a", "b b b", "c", f"u{i}"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for hot in (1, 5, 10**9):  # no key is hot; some are; all are
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got.append({r.doc_id: r.text for r in line_dedup.line_dedup(docs, 4).collect()})
    want = plain_line_dedup(rows, 4)
    assert got[0] == got[1] == got[2] == {i: want.get(i, t) for i, t in rows}


# 2


def test_ids_beyond_two_bytes(spark, tmp_path):
    import base64

    words = [bytes([b]) for b in range(256)] + [b"a" + bytes([k // 256, k % 256]) for k in range(65536 - 256)] + [b"zq"]
    vocabulary = tmp_path / "large.tiktoken"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(w) + b" " + str(i).encode() for i, w in enumerate(words)))
    docs = spark.createDataFrame([(1, "zqzq"), (2, None), (3, "ab zq")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(docs, str(vocabulary), 70_000).collect()}
    assert got == {1: 2, 2: 0, 3: 4}
    with pytest.raises(Exception, match="can't hold the id"):
        token_counts.flat_files(docs, str(vocabulary), 60_000).collect()
    with pytest.raises(ValueError, match="can't hold the id"):
        token_counts.flat_files(docs, str(vocabulary), 70_000)


# 4


def test_mixing(spark, odd):
    rows = mixing.rates(odd).collect()
    assert len(rows) == odd.count()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = dict(zip(order, (3, 1, 2, 3)))
    target, fixed = {}, set()
    while True:  # deal by weight, stop at the cap, deal the excess again
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in fixed)
        target = {s: 2 * sizes[s] if s in fixed else left * weight[s] / sum(weight[x] for x in order if x not in fixed) for s in order}
        over = {s for s in order if s not in fixed and target[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= over
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert {r["size"] for r in rows if r.doc_id in (3, 4, 7)} == {0}
    again = sorted(map(str, mixing.rates(odd).collect()))
    assert again == sorted(map(str, rows))
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)


def test_mixing_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(20000)], "doc_id long, text string, source string")
    sums = mixing.rates(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.k / r.t - 1) < 0.05 for r in sums)


def test_mixing_of_nothing(empty):
    assert mixing.rates(empty).collect() == [] and mixing.mixed(empty).collect() == []


# 5


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_simhash(spark, odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    fps = {(i, t): plain_fingerprint(t) for i, t, *_ in odd_rows}
    assert sorted((r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((i or 0, plain_fingerprint(t)) for i, t, *_ in odd_rows)
    values = set(fps.values())
    root = classes([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3], values)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in got)
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.doc_id is None or r.component_id == r.doc_id)


@pytest.mark.parametrize("many", [20_000, 5])
def test_links_lose_no_component(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:80]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
            values.add(v)
    hot = rng.getrandbits(64)
    values |= {hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(8)) for _ in range(200)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed * 2], "fp long")
    links = [(r.a, r.b) for r in simhash.links(df).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    assert classes(links, signed) == classes(near, signed)


@pytest.mark.parametrize("chunk", [200_000, 60])
@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, monkeypatch, shape, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(7)
    n = 400
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(300)], "none": []}[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + edges[:5] + [(3, 3), (None, 1)], "a long, b long").repartition(7)
    got = {r.node: r.comp for r in components.connected_components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = classes(edges, nodes)
    assert set(got) == nodes
    assert len({(got[x], want[x]) for x in nodes}) == len(set(got.values())) == len(set(want.values()))


# 6


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(3)
    train = [rng.randrange(1, 5) for _ in range(300)]
    a = langid.Automaton(np.array(train), 8)
    joined = bytes(train)
    for _ in range(50):
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))]
        n = i = 0
        while i < len(text):
            k = i + 1
            while k < len(text) and text[i] in joined and bytes(text[i : k + 1]) in joined:
                k += 1
            n, i = n + 1, k
        grid = np.array(text, np.uint8)[:, None]
        assert a.phrases(grid, [1] * len(text))[0] == n


def test_phrases_go_on_over_pieces(monkeypatch):
    rng = random.Random(6)
    own = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(3)]
    model = langid.learn({f"l{k}": [t] for k, t in enumerate(own)})
    texts = [(rng.choice(own)[rng.randrange(300) :] * rng.randrange(1, 6) + "".join(rng.choice("abcdé ") for _ in range(rng.randrange(200)))).encode() for _ in range(30)]
    said = []
    for piece in (10**6, 64, 7, 1):
        monkeypatch.setattr(langid, "PIECE", piece)
        said.append(model.predict(texts))
    assert said[0] == said[1] == said[2] == said[3]


def test_language_id(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(langid.sample(docs))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any(c.isalpha() for c in r.text)]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    rows = langid.identify(odd, model).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.with_language(odd, model, "p", "s").columns == [*odd.columns, "p", "s"]
    assert langid.identify(empty, model).collect() == []
    nothing = langid.learn(langid.sample(empty))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_pieces_and_order_do_not_matter(spark):
    model = langid.learn({"a": ["lorem ipsum dolor sit amet " * 20], "b": ["the quick brown fox jumps " * 20]})
    texts = [b"lorem dolor " * 500, b"brown quick fox", b"", "ééé".encode(), b"the fox " * 300]
    alone = [tuple(x[0] for x in model.predict([t])) for t in texts]
    assert list(zip(*model.predict(texts))) == alone
    assert [k for k, _ in alone[:2]] == ["a", "b"] and alone[2] == ("und", 0.0)


# 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abst'rvelmdS 19\n\t\r.,! 　"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_bpe_equals_the_library(reference, texts):
    t = bpe.tokenizer(PATH)
    for text, ids in zip(texts, t.encode([x.encode() for x in texts])):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert t.decode(ids) == text.encode() and t.offsets(ids)[-1] == len(text.encode())


def test_bpe_long_pieces(reference):
    t = bpe.tokenizer(PATH)
    for text in ("a" * 5000, "ab" * 3000 + "'s", " " * 4000 + "x", "é" * 2000, "!" * 999, "the" * 1500):
        assert np.frombuffer(next(t.encode([text.encode()])), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_class_of_every_code_point(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)}" for c in points]
    t = bpe.tokenizer(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in t.encode([x.encode() for x in texts])]
    assert got == [reference.encode_ordinary(x) for x in texts]


def test_scan_of_transition_functions():
    rng = np.random.default_rng(1)
    f = rng.integers(0, len(bpe.THEN), 5000).astype(np.uint8)
    want = [f[0]]
    for x in f[1:]:
        want.append(bpe.THEN[want[-1], x])
    assert (bpe.scan(f) == np.array(want)).all()


def test_bpe_tables(spark, odd, odd_rows, empty, reference):
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH).collect()))
    want = []
    for i, t, *_ in odd_rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(empty, PATH).collect() == []
    back = {r.doc_id: bytes(r.text).decode() for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t, *_ in odd_rows}


# 2


@pytest.mark.parametrize("block", [1, 3, 50])
def test_counts_across_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_counts, "SPAN", 4)
    rng = random.Random(block)
    want = {}
    for name in ("a", "b", "c"):
        docs = [[rng.randrange(5) for _ in range(rng.choice([0, 1, 2, 9, 40]))] for _ in range(12)]
        flat = [x for d in docs for x in [*d, 7]]
        if name == "b":
            flat += [1, 2, 3]
            docs.append([1, 2, 3])
        want |= {(name, i): len(d) for i, d in enumerate(docs)}
        (tmp_path / name).write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "empty").write_bytes(b"")
    blocks = token_counts.read_flat(spark, str(tmp_path), block=block)
    got = {(r.file.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in token_counts.counts(blocks, 7).collect()}
    assert got == want


def test_document_counts(spark, odd, odd_rows, empty, reference):
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.document_counts(odd, PATH, 50_256).collect())
    assert got == sorted((i or 0, len(reference.encode_ordinary(t or ""))) for i, t, *_ in odd_rows)
    assert token_counts.document_counts(empty, PATH, 50_256).collect() == []


# 9


def test_edited_texts(spark, odd, odd_rows, empty):
    rows = [(i, t or "") for i, t, *_ in odd_rows]
    got = spotsigs.edited_likeness(odd).collect()
    assert len(got) == len(rows)
    order = sorted({(-i if i is not None else math.inf, t) for i, t in rows})
    twice = rows.count((1, rows[0][1]))
    order = [x for x in order for _ in range(twice if x[0] == -1 else 1)]
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]
        want[(-i if i != math.inf else None, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert spotsigs.edited_likeness(empty).collect() == []


def plain_signatures(text, common, chain=spotsigs.CHAIN):
    """The set of signatures of a text as tuples of words: the anchor before and the content words of each chain."""
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    content = [i for i, w in enumerate(words) if w not in common]
    out = set()
    for k, i in enumerate(content):
        begin = content[k - 1] + 1 if k else 0
        if begin < i and k + chain <= len(content):
            out.add((*words[begin:i], *(words[x] for x in content[k : k + chain])))
    return out or ({tuple(words)} if words else set())


def test_likenesses_and_fingerprints_equal_a_plain_version(spark, odd, odd_rows):
    rng = random.Random(12)
    vocabulary = [*spotsigs.COMMON[:6], "Apple", "pear", "fig", "naïve", "x1", "一二"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) + rng.choice([".", "", "\n"]) for _ in range(40)]
    more = [(100 + i, t, "en", "s") for i, t in enumerate(texts)] + [(200 + i, t, "en", "s") for i, t in enumerate(texts[:9])]
    rows = [r for r in odd_rows if r[0] != 1] + more  # rows that stand twice have their own test
    docs = table(spark, rows)
    order = sorted(((-i if i is not None else math.inf, t or "") for i, t, *_ in rows))
    for common in (list(spotsigs.COMMON), ["pear"]):
        sets = [plain_signatures(t, common) for _, t in order]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        want, names = {}, {}
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            edited = plain_signatures(t[: len(t) - len(t) // 2] + after[: len(t) // 2], common)
            want[-i if i != math.inf else None] = like(sets[k], edited), like(sets[k], sets[(k + 1) % len(order)])
            names[-i if i != math.inf else None] = frozenset(sets[k])
        got = {r.doc_id: r for r in spotsigs.edited_likeness(docs, common=common).collect()}
        assert {i: (r.near_edited, r.near_next) for i, r in got.items()} == {i: (pytest.approx(a), pytest.approx(b)) for i, (a, b) in want.items()}
        # equal fingerprints where, and only where, the sets of signatures are equal
        assert len({(got[i].fingerprint, names[i]) for i in got}) == len(set(names.values())) == len({r.fingerprint for r in got.values()})


def test_anchors_by_document_frequency(spark):
    rng = random.Random(1)
    rows = [(i, "xx", " ".join(["ku", "ma", *(f"w{rng.randrange(5000)}" for _ in range(8)), "the"])) for i in range(40)]
    rows += [(100 + i, None, f"often only {i}") for i in range(20)] + [(200 + i, "few", "rare words") for i in range(5)] + [(300, "xx", None)]
    got = spotsigs.anchors(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(got) - set(spotsigs.COMMON) == {"ku", "ma", "often", "only"} and got == sorted(got)
    assert spotsigs.anchors(spark.createDataFrame([], "lang string, text string")) == sorted(set(spotsigs.COMMON))


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_many_rows_of_one_id_are_cut(spark, rows):
    ids = [7] * 40 + [None] * 30 + list(range(20))
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    placed = spotsigs.with_next(docs, rows).collect()
    buckets = collections.defaultdict(list)
    for r in placed:
        buckets[r.bucket].append((r.guest, r.doc_id is None, -(r.doc_id or 0), r.tie, r.text))
    assert rows > 1 or max(sum(not g for g, *_ in x) for x in buckets.values()) <= 12
    chain = {}
    for x in buckets.values():
        x.sort()
        assert sum(g for g, *_ in x) == 1
        chain |= {a[-1]: b[-1] for a, b in zip(x, x[1:])}
    tie = {r.text: r.tie for r in placed}
    order = [t for _, _, _, t in sorted((i is None, -(i or 0), tie[f"t{k}"], f"t{k}") for k, i in enumerate(ids))]
    assert chain == {a: b for a, b in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_next_document_across_buckets(spark, rows):
    ids = random.Random(rows).sample(range(-1000, 10**6), 60)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    placed = spotsigs.with_next(docs, rows).collect()
    buckets = collections.defaultdict(list)
    for r in placed:
        buckets[r.bucket].append((r.guest, -r.doc_id))
    follows = {}
    for b in buckets.values():
        b.sort()
        assert [g for g, _ in b].count(True) == 1
        follows |= {-a[1]: -c[1] for a, c in zip(b, b[1:])}
    down = sorted(ids, reverse=True)
    assert follows == dict(zip(down, [*down[1:], down[0]]))


def test_signatures(spark):
    texts = ["The quick fox, of the lazy dog in a house", "quick fox", "", None, "the of"]
    df = spotsigs.with_signatures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s")
    sizes = [len(r.s) for r in df.collect()]
    assert sizes == [2, 1, 0, 0, 1]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_documents(spark, threshold):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [x for _ in range(rng.randrange(3, 25)) for x in ("the", rng.choice(words), rng.choice(words))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    members, links = spotsigs.similar(docs, threshold)
    sets = {r.doc_id: frozenset(r.s) for r in spotsigs.with_signatures(docs, "text", "s").collect() if r.s}
    own = {i: min(j for j, t in sets.items() if t == s) for i, s in sets.items()}
    assert {(r.doc_id, r.class_id) for r in members.collect()} == set(own.items())
    reps = sorted(set(own.values()))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    got = {(r.a, r.b): r.likeness for r in links.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= threshold}


def test_dedup_of_nothing(empty):
    assert line_dedup.line_dedup(empty, removed_as="n").collect() == []
    assert simhash.near_duplicates(empty).collect() == [] and simhash.near_dedup(empty).collect() == []
