"""Line dedup: winnowing over line hashes finds repeated runs of lines; the later ones are deleted.

A run of whole lines with `least` words or more in all is deleted where it occurred before (in an earlier document,
by doc_id, or further up). Windows are the shortest runs of lines that reach `least` words, from each line on and up
to each line. Winnowing keeps the place of each window's least line hash (the last one, if several are equal): equal
windows have it at the same line, so that any repeated run has a kept hash in common with its first occurrence. Places
are joined by that hash; those without a partner drop out, and no text is looked at for them again. Around the others
the match is extended both ways over the line hashes as far as the windows reach that the hash was kept for: they meet
on digests of their lines' hashes, made for these windows alone, and the first place of each is the one that stays.
Windows that overlap or touch extend each other to the whole run. (Comparing the places of a hash with one another
would be all pairs of a group; a digest finds the first equal one in linear time.)

Passages that begin or end inside a line are found on words (passages()): runs of GRAM words are hashed, and the least
hash of any PASSAGE_WORDS words in a row is selected, so that two equal runs of PASSAGE_WORDS words have a selected
hash in common. Runs of PASSAGE_WORDS words whose least hash was selected at more than one place meet on digests;
overlapping ones extend each other both ways to the whole passage, of which the later occurrence is deleted.

A place is (doc_id, hash of the text, line or word): rows with one doc_id and different texts are different places,
in the order of their texts' hashes; rows with equal doc_id and text are one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, as_bytes, fresh, map_batches, slices, stored

#: A run of whole lines with so many words is always found; a passage within lines only by passages().
LEAST_WORDS = 50
#: The same where repeated short lines are to go as well.
SHORT_WORDS = 5
#: A repeated passage of so many words is always found by passages(), wherever it begins; words that are hashed as one.
PASSAGE_WORDS, GRAM = 50, 25
#: A key that has more than this part of all rows is hot.
HOT = 1000
#: Odd bases of the polynomials over words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def windows(words: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(first line, last line) of the shortest runs with `least` words, from each line on and up to each line; neither
    ever goes back."""
    out: list[tuple[int, int]] = []
    i = fresh_from = total = 0  # of lines i to j; lines from fresh_from on have no run yet
    for j, n in enumerate(words):
        total += n
        if total >= least:
            while total - words[i] >= least:
                total -= words[i]
                i += 1
            out += [(x, j) for x in range(fresh_from, i)]
            out.append((i, j))
            fresh_from = i + 1
    return out


def kept(hashes: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """The line of each window's least hash, the last one of equals; windows in order."""
    queue: deque[int] = deque()
    out, upto = [], 0
    for i, j in spans:
        while upto <= j:
            while queue and hashes[queue[-1]] >= hashes[upto]:
                queue.pop()
            queue.append(upto)
            upto += 1
        while queue[0] < i:
            queue.popleft()
        out.append(queue[0])
    return out


def digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """128 bits for each run of lines, as two arrays: polynomials over the lines' hashes, by prefix sums."""
    out = []
    for base in BASES:
        up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)])
        x = (up[last + 1] - up[first]) * _powers(pow(base, -1, 1 << 64), len(hashes))[first] + (last - first).astype(np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((x ^ (x >> np.uint64(29))).view(np.int64))
    return out


def _own(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, text) of the rows that are looked at."""
    text = F.col("text").cast("string")
    return docs.filter(F.col("doc_id").isNotNull() & text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def _lines_of(own: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_id, hashes, words, kept hashes) of each text that has `least` words: all that is needed of its lines."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = as_bytes(b.column(2))
        for s, e in slices(text, 2_000_000):
            at, out = [], []
            for k in range(s, e):
                lines = text[k].as_py().split(b"\n")
                words = [len(x.split()) for x in lines]
                if sum(words) >= least:
                    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
                    marks = sorted(set(kept(hashes, windows(words, least))))
                    at.append(k)
                    out.append((np.array(hashes, np.uint64).view(np.int64), words, np.array([hashes[m] for m in marks], np.uint64).view(np.int64)))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([x for x, _, _ in out], pa.list_(pa.int64())),
                     pa.array([x for _, x, _ in out], pa.list_(pa.int32())), pa.array([x for _, _, x in out], pa.list_(pa.int64()))],
                    ["doc_id", "text_id", "hashes", "words", "fps"],
                )

    return map_batches(own, run, "doc_id long, text_id long, hashes array<long>, words array<int>, fps array<long>")


def met(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The rows whose keys occur more than once, with the first place of each as column `first`.

    Keys are counted before the shuffle. A key with more than a HOTth of all rows (less than HOT keys, whatever the
    input) goes to the rows by broadcast, so that no task has all rows of it; other rows go to their keys.
    """
    counts = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")).filter("n > 1"))
    many = rows.count() // HOT
    hot = F.broadcast(counts.filter(F.col("n") > many).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(counts.filter(F.col("n") <= many).drop("n"), keys))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_id, spans array<struct<i, j>>): each text's windows that occurred before, by line numbers from 0."""
    found = stored(_lines_of(_own(docs), least))
    marks = found.select("doc_id", "text_id", F.posexplode("fps").alias("at", "fp"))
    near = met(marks, ["fp"], ["doc_id", "text_id", "at"]).groupBy("doc_id", "text_id").agg(F.collect_set("fp").alias("near"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, text_id, hashes, words, near in zip(*(b.column(i) for i in range(5))):
            h, near = hashes.values.to_numpy().view(np.uint64), set(near.as_py())
            spans, signed = windows(words.as_py(), least), hashes.as_py()
            take = [x for x, m in zip(spans, kept(h.tolist(), spans)) if signed[m] in near]
            i, j = np.array(take, np.int64).reshape(-1, 2).T
            w1, w2 = digests(h, i, j)
            same = [pa.array(np.full(len(i), x.as_py(), np.int64)) for x in (doc, text_id)]
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *same, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["w1", "w2", "doc_id", "text_id", "i", "j"])

    around = found.join(near, ["doc_id", "text_id"]).select("doc_id", "text_id", "hashes", "words", "near")
    place = ["doc_id", "text_id", "i"]
    extended = stored(map_batches(around, run, "w1 long, w2 long, doc_id long, text_id long, i int, j int"))
    later = met(extended, ["w1", "w2"], place).filter(F.struct(*place) > F.col("first"))
    return later.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("i", "j")).alias("spans"))


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the spans, and how many lines those are."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int32)
    for i, j in spans:
        gone[i] += 1
        gone[j + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return "\n".join(x for x, g in zip(lines, gone) if not g), int(gone.sum())


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64."""
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def grams(words: list[bytes], k: int, base: int) -> np.ndarray:
    """A hash of each k words in a row: a polynomial over the words' XXH64, shifted to begin at power 0."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, n), dtype=np.uint64)])
    x = (up[k:] - up[:-k]) * _powers(pow(base, -1, 1 << 64), n - k + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """f over each k values in a row, by doubling."""
    n, done = len(x) - k + 1, 1
    while done < k:
        step = min(done, k - done)
        x = f(x[:-step], x[step:])
        done += step
    return x[:n]


def selected(words: list[bytes], passage: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of runs of GRAM words (half a passage, if that is less) that are least among those of any
    `passage` words in a row."""
    k = min(GRAM, (passage + 1) // 2)
    if len(words) < passage:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, w = grams(words, k, BASES[0]), passage - k + 1
    least = _slide(h, w, np.minimum)
    # no minimum of a window that holds the place is more than its own hash; the greatest tells whether one equals it
    zeros = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([zeros, least, zeros]), w, np.maximum) == h)
    return at, h[at]


def _selected_of(docs: DataFrame, passage: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, ids = as_bytes(b.column(2)), [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        for s, e in slices(text, 2_000_000):
            found = [selected(x.as_py().split(), passage) for x in text.slice(s, e - s)]
            at, fp = (np.concatenate(x) for x in zip(*found))
            n = [len(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *(pa.array(np.repeat(x[s:e], n), pa.int64()) for x in ids), pa.array(at.astype(np.int32))], ["fp", "doc_id", "text_id", "at"])

    return map_batches(docs, run, "fp long, doc_id long, text_id long, at int")


def covered(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each word of the text lies in one of the spans of lines."""
    lines = text.encode().split(b"\n")
    gone = np.zeros(len(lines), bool)
    for i, j in spans:
        gone[i : j + 1] = True
    return np.repeat(gone, [len(x.split()) for x in lines])


def passages(docs: DataFrame, lines: DataFrame, passage: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text_id, runs array<int>): first words, from 0, of the runs of `passage` words that occurred before.

    lines (doc_id, text_id, spans) are repeats() of docs; runs that lie in them go anyhow, and are left out here.
    """
    own = _own(docs)
    found = stored(_selected_of(own, passage))
    near = met(found, ["fp"], ["doc_id", "text_id", "at"]).groupBy("doc_id", "text_id").agg(F.collect_set("fp").alias("fps"))
    k = min(GRAM, (passage + 1) // 2)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, text_id, text, fps, spans in zip(*(b.column(i).to_pylist() for i in range(5))):
            words = text.encode().split()
            # a run that occurs twice has its least hash at two selected places
            take = np.isin(_slide(grams(words, k, BASES[0]), passage - k + 1, np.minimum).view(np.int64), fps)
            if spans:
                left = np.concatenate([[0], np.cumsum(~covered(text, [(s["i"], s["j"]) for s in spans]))])
                take &= left[passage:] > left[:-passage]
            i = np.flatnonzero(take)
            w1, w2 = (grams(words, passage, base)[i].view(np.int64) for base in BASES)
            same = [pa.array(np.full(len(i), x, np.int64)) for x in (doc, text_id)]
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *same, pa.array(i.astype(np.int32))], ["w1", "w2", "doc_id", "text_id", "i"])

    both = ["doc_id", "text_id"]
    around = own.join(near, both).join(lines, both, "left").select(*both, "text", "fps", "spans")
    extended = stored(map_batches(around, run, "w1 long, w2 long, doc_id long, text_id long, i int"))
    later = met(extended, ["w1", "w2"], [*both, "i"]).filter(F.struct(*both, "i") > F.col("first"))
    return later.groupBy(*both).agg(F.collect_set("i").alias("runs"))


def without_passages(text: str, spans: list[tuple[int, int]], runs: list[int], passage: int = PASSAGE_WORDS) -> tuple[str, int]:
    """The text without the lines of the spans and without the runs of words, and how many lines went as a whole.

    A word goes with the white space that follows it in its line; a line that loses all its words goes.
    """
    lines = text.encode().split(b"\n")
    whole = np.zeros(len(lines), bool)
    for i, j in spans:
        whole[i : j + 1] = True
    sizes = [len(x.split()) for x in lines]
    edges = np.zeros(sum(sizes) + passage + 1, np.int32)
    x = np.array(runs, np.int64)
    np.add.at(edges, x, 1)
    np.add.at(edges, x + passage, -1)
    gone = np.cumsum(edges) > 0
    out, at = [], 0
    for line, n, all_gone in zip(lines, sizes, whole.tolist()):
        cut = gone[at : at + n]
        at += n
        if all_gone or (n and cut.all()):
            continue
        if cut.any():
            begins = [m.start() for m in re.finditer(WORD.encode(), line)]
            line = line[: begins[0]] + b"".join(line[a:b] for a, b, c in zip(begins, [*begins[1:], len(line)], cut.tolist()) if not c)
        out.append(line)
    return b"\n".join(out).decode(), len(lines) - len(out)


def line_dedup(docs: DataFrame, least: int = LEAST_WORDS, removed_as: str = "lines_removed", passage: int | None = None) -> DataFrame:
    """docs with the text's repeated runs deleted, and one more column, the number of lines removed.

    A text whose lines are all repeated becomes empty; null and empty texts stay, with 0 lines removed; rows without
    a doc_id are neither changed nor looked at. Lines with less than `least` words in all stay, however frequent. Rows
    with equal doc_id and text are one place, and all are cut alike; of different texts with one doc_id each has its
    own. All columns are kept; if `removed_as` is among them, the new one has underscores before its name (fresh()).
    An empty table gives an empty one. With `passage`, repeated runs of so many words or more are deleted as well,
    wherever in a line they begin or end; lines that lose all words count as removed.
    """
    removed_as = fresh(docs, removed_as)
    doc, text_id, cuts = fresh(docs, "_doc"), fresh(docs, "_text_id"), fresh(docs, "_spans")
    spans = repeats(docs, least)
    if passage:
        spans = stored(spans)
        spans = spans.join(passages(docs, spans, passage), ["doc_id", "text_id"], "full").select("doc_id", "text_id", F.struct("spans", "runs"))
    spans = spans.toDF(doc, text_id, cuts)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, found = b.column(at), b.column(b.num_columns - 1)
        out, removed = [], []
        for k in range(b.num_rows):
            c, text, n = found[k].as_py(), texts[k].as_py(), 0
            if c and passage:
                text, n = without_passages(text, [(x["i"], x["j"]) for x in c["spans"] or []], c["runs"] or [], passage)
            elif c:
                text, n = without(text, [(x["i"], x["j"]) for x in c])
            out.append(text)
            removed.append(n)
        columns = b.columns[:-1]
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*b.schema.names[:-1], removed_as])

    own = docs.withColumn("text", F.col("text").cast("string"))
    joined = own.join(spans, (own["doc_id"] == spans[doc]) & (F.xxhash64(own["text"]) == spans[text_id]), "left").drop(doc, text_id)
    schema = T.StructType([*own.schema.fields, T.StructField(removed_as, T.LongType())])
    return map_batches(joined, run, schema)
