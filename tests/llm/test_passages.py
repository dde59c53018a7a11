"""Repeated passages that begin or end inside lines."""

import random

import pytest

from tracewell.llm import line_dedup
from tracewell.llm.queries import QUERIES


def plain_passages(rows, least, passage):
    """Words left in each text: not in a line run that occurred before, nor in a run of words that did."""
    first, firsts, out = {}, {}, {}
    docs = sorted({(i, t) for i, t in rows if i is not None and t})
    gone = {}
    for i, t in docs:
        lines = t.split("\n")
        own = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least and first.setdefault(tuple(lines[a:b]), (i, a)) < (i, a):
                    own |= set(range(a, b))
        gone[i] = [k in own for k, x in enumerate(lines) for _ in x.split()]
    for i, t in docs:
        w = t.split()
        cut = list(gone[i])
        for s in range(len(w) - passage + 1):
            if not all(gone[i][s : s + passage]) and firsts.setdefault(tuple(w[s : s + passage]), (i, s)) < (i, s):
                cut[s : s + passage] = [True] * passage
        out[i] = [x for x, c in zip(w, cut) if not c]
    return out


@pytest.mark.parametrize("passage", [4, 9])
def test_passages_equal_all_runs_of_words(spark, passage):
    rng = random.Random(passage)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 20))) for _ in range(12)]
    rows = [(i, "\n".join(" ".join(rng.choice([rng.choice(pool), "x y", "z", f"q{rng.randrange(99)}"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    got = {r.doc_id: r.text.split() for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 12, passage=passage).collect()}
    assert got == plain_passages(rows, 12, passage)


def test_a_passage_inside_a_line_goes(spark, odd, odd_rows):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    own = [text(7) for _ in range(4)]
    shared = text(50)
    rows = [(1, f"{own[0]} {shared} {own[1]}"), (2, f"{own[2]}  {shared}\t{own[3]}\nend"), (3, f"{own[0]}\n{shared[:200]}"), (4, f"\n{shared}\n{own[1]}"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.line_dedup(df, passage=50).collect()}
    want = {i: (t, 0) for i, t in rows}
    want[2] = (f"{own[2]}  {own[3]}\nend", 0)
    assert {k: got[k] for k in (1, 2, 3, 5, 6)} == {k: want[k] for k in (1, 2, 3, 5, 6)}
    assert got[4] == ("", 2)  # the passage goes on over the line's end, as in document 1
    again = line_dedup.line_dedup(odd, removed_as="n_removed", passage=50)
    assert again.count() == len(odd_rows) and again.columns == [*odd.columns, "n_removed"]


def test_selected_hashes_cover_every_passage():
    rng = random.Random(1)
    words = [str(rng.randrange(30)).encode() for _ in range(400)]
    for passage in (1, 2, 5, 50):
        at, _ = line_dedup.selected(words, passage)
        k = min(line_dedup.GRAM, (passage + 1) // 2)
        assert all(any(s <= a <= s + passage - k for a in at) for s in range(len(words) - passage + 1))
        assert passage < 50 or len(at) < len(words) / 5


def test_repeated_short_lines_go(spark, tmp_path):
    notice = "All rights reserved by the owner of this page"
    rows = [(i, f"text {i} alone\n{notice}\nto {i} end\nfour words stay here") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in QUERIES["op1_passage_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: t if i == 0 else t.replace(notice + "\n", "") for i, t in rows}
