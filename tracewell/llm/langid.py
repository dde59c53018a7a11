"""Language ID by cross-parsing: the language whose training text parses a document into the fewest phrases wins.

A suffix automaton of a language's training text gives, from any place of a document, the longest match that occurs
in the training text. Greedy longest matches cut the document into phrases; phrases times log2(training length) over
the document's length estimates the cross entropy. The automaton steps through pieces of PIECE letters side by side, and
then again through the beginnings of pieces, with the state that the piece before ended in, until it is where it was:
the phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, map_batches, slices

#: Bounds of the sample that is learned from: documents and symbols of each language, half the characters of one
#: document, symbols of all languages together.
DOCS, LETTERS, PER_DOC, ALL_LETTERS = 200, 30_000, 600, 600_000
#: Symbols: gap, letters that no sample has, DIRECT letters as they are; all others are spelled, LEADS[0] * DIGITS^2 of
#: them with a lead and two digits, the rest (LEADS[1] * DIGITS^4, more than there are letters) with a lead and four.
DIRECT, LEADS, DIGITS = 40, (4, 4), 14
WIDTH = 2 + DIRECT + sum(LEADS) + DIGITS
PIECE = 1024
UNKNOWN = "und"


def letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter (Unicode category L*)."""
    return _tables()[1][points]


_cached: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Of each code point: its lower case if that is one code point, else itself; and whether it is a letter."""
    if not _cached:
        lower, letter = np.arange(0x110000, dtype=np.int32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                if len(low := s.lower()) == 1:
                    lower[c] = ord(low)
        _cached.extend((lower, letter))
    return _cached


def points_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<i4")


def _gapped(points: np.ndarray) -> np.ndarray:
    """Lower-case letters as code points; each run of anything else as one gap, 0."""
    lower, letter = _tables()
    x = np.where(letter[points], lower[points], 0)
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    return x[keep]


class Automaton:
    """Suffix automaton of a symbol sequence as a dense table: next state times width, or -1."""

    def __init__(self, text: np.ndarray, width: int):
        longest, link, nxt = [0], [-1], [{}]
        last = 0
        for c in text.tolist():
            cur = len(nxt)
            longest.append(longest[last] + 1)
            link.append(0)
            nxt.append({})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if longest[p] + 1 == longest[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    nxt.append(dict(nxt[q]))
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        # the last state has no way on: there a symbol leads that never occurs, which is a phrase by itself
        self.table = np.full((len(nxt) + 1, width), -1, np.int32)
        self.table[0] = len(nxt) * width
        for q, to in enumerate(nxt):
            for c, r in to.items():
                self.table[q, c] = r * width
        self.table = self.table.ravel()
        self.first = self.table[:width].copy()

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended before the symbol."""
        to = self.table[state + symbols]
        miss = to < 0
        np.copyto(to, self.first[symbols], where=miss)
        return to, miss

    def phrases(self, symbols: np.ndarray, active: list[int], after: np.ndarray | None = None) -> np.ndarray:
        """Number of phrases that end within each column of symbols (steps by pieces), or with it if none follows; at
        step i the first active[i] columns go on. after: the column that comes before each one in its text (one as
        long as there are steps), or -1."""
        after = np.full(symbols.shape[1], -1) if after is None else after
        states, ended = np.zeros(symbols.shape, np.int32), np.zeros(symbols.shape, bool)
        state = np.zeros(symbols.shape[1], np.int32)
        for i, k in enumerate(active):
            state[:k], ended[i, :k] = self._step(state[:k], symbols[i, :k])
            states[i, :k] = state[:k]
        following = np.flatnonzero(after >= 0)
        todo = following
        while len(todo):
            at, state = todo, states[-1, after[todo]]
            for i, k in enumerate(active):
                some = at < k  # shorter pieces are over
                at, state = at[some], state[some]
                state, miss = self._step(state, symbols[i, at])
                new = states[i, at] != state
                ended[i, at], states[i, at] = miss, state
                at, state = at[new], state[new]
                if not len(at):
                    break
            todo = following[np.isin(after[following], at)]  # what still differs at its end goes on in the next piece
        return ended.sum(axis=0) + ~np.isin(np.arange(len(after)), after[following])


@dataclass
class Alphabet:
    """Letters of all samples, the most frequent first; each keeps its identity."""

    common: np.ndarray

    def __post_init__(self):
        self.symbol = np.full(0x110000, 1, np.uint8)
        self.symbol[0] = 0
        self.symbol[self.common[:DIRECT]] = np.arange(2, 2 + len(self.common[:DIRECT]))
        rest = self.common[DIRECT:]
        self.symbol[rest] = 255
        self.rank = np.argsort(rest, kind="stable")
        self.points = rest[self.rank]

    def encode(self, gapped: np.ndarray) -> np.ndarray:
        """Symbols of lower-case letters and gaps."""
        s = self.symbol[gapped]
        spelled = np.flatnonzero(s == 255)
        if not len(spelled):
            return s
        r = self.rank[np.searchsorted(self.points, gapped[spelled])]
        short = LEADS[0] * DIGITS**2
        far = r >= short
        n = np.ones(len(s), np.int64)
        n[spelled] = np.where(far, 5, 3)
        out, at = np.repeat(s, n), np.cumsum(n)[spelled] - 1  # the last symbol of each
        for lead, digits, which, x in ((2 + DIRECT, 2, ~far, r), (2 + DIRECT + LEADS[0], 4, far, r - short)):
            x, end = x[which], at[which]
            for k in range(digits):
                out[end - k] = 2 + DIRECT + sum(LEADS) + x % DIGITS
                x = x // DIGITS
            out[end - digits] = lead + x
        return out


@dataclass
class Model:
    """Learned languages, the alphabet, automata, and log2 of each training length."""

    langs: list[str]
    alphabet: Alphabet
    automata: list[Automaton]
    bits: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each UTF-8 text; no letter: und with score 0. The score is the share of the best
        language where a language weighs 2 to the power of minus 8 times its bits per letter; ties go to the first."""
        points = [points_of(t) for t in texts]
        known = [bool(len(p)) and bool(letters(p).any()) for p in points]
        owner, pieces, before, total = [], [], [], np.ones(len(texts))
        for i, p in enumerate(points):
            if known[i] and self.langs:
                g = _gapped(p)
                s = self.alphabet.encode(g)
                total[i] = len(g)
                for j in range(0, len(s), PIECE):
                    before.append(len(owner) - 1 if j else -1)
                    owner.append(i)
                    pieces.append(s[j : j + PIECE])
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        counts = np.zeros((len(self.langs), len(texts)))
        if len(order):
            ranked = lengths[order]
            grid = np.zeros((len(order), int(ranked[0])), np.uint8)
            for r, k in enumerate(order):
                grid[r, : lengths[k]] = pieces[k]
            grid = np.ascontiguousarray(grid.T)
            active = np.searchsorted(-ranked, -np.arange(len(grid)), side="left").tolist()
            of, column, before = np.array(owner)[order], np.argsort(order), np.array(before)[order]
            after = np.where(before >= 0, column[before], -1)
            for a, automaton in enumerate(self.automata):
                counts[a] = np.bincount(of, automaton.phrases(grid, active, after), len(texts))
        langs, scores = [], []
        for i in range(len(texts)):
            if not known[i] or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            bits = counts[:, i] * self.bits / total[i]
            w = np.exp2(-8 * (bits - bits.min()))
            langs.append(self.langs[int(bits.argmin())])
            scores.append(float(1 / w.sum()))
        return langs, scores


def _evenly(docs: list[np.ndarray], most: int) -> np.ndarray:
    """The documents one after the other, each cut to the same length at which they have `most` symbols together."""
    sizes = np.sort([len(x) for x in docs])
    up, left = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes), 0, -1)
    level = next((-(-(most - int(u)) // int(n)) for u, n, x in zip(up, left, sizes) if u + n * x >= most), most)
    return np.concatenate([x[:level] for x in docs])[:most]


def learn(samples: dict[str, list[str]]) -> Model:
    """Model of sample texts per language; ties go to the language that comes first."""
    langs = list(samples)
    each = min(LETTERS, ALL_LETTERS // max(1, len(langs)))
    docs = [[np.append(_gapped(points_of(t.encode())), 0) for t in samples[k]] for k in langs]
    values, n = np.unique(np.concatenate([x for d in docs for x in d]) if docs else np.empty(0, np.int32), return_counts=True)
    common = values[np.lexsort((values, -n))]
    alphabet = Alphabet(common[common != 0])
    seqs = [_evenly([alphabet.encode(x) for x in d], each) for d in docs]
    return Model(langs, alphabet, [Automaton(s, WIDTH) for s in seqs], np.log2([max(2, len(s)) for s in seqs]))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts to learn from, the most frequent language first: of each labelled language at most DOCS documents, chosen
    by a hash of doc_id, and of each PER_DOC * 2 characters that begin at a place given by such a hash.

    Documents held out (crc32 of doc_id modulo 5 is 0) have no part in any of this, nor have those without a letter.
    """
    own = docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    by_lang = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    rank = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 40))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("place")), F.greatest(F.lit(1), F.length("text") - 2 * PER_DOC + 1)) + 1
    part = F.substring("text", place.cast("int"), 2 * PER_DOC)
    out: dict[str, list[str]] = {k: [] for k in by_lang}
    if by_lang:
        # twice the documents wanted, as some are without letters; a language of few gives all
        cut = F.element_at(F.create_map(*[F.lit(x) for k, n in by_lang.items() for x in (k, int((1 << 40) * min(1.0, 2 * DOCS / n)))]), F.col("lang"))
        rows = own.withColumn("_r", rank).filter(F.col("_r") < cut).select("lang", "_r", part.alias("text")).filter(F.col("text").rlike(r"\p{L}"))
        for r in sorted(rows.orderBy("_r", "lang", "text").limit(8 * DOCS * len(by_lang)).collect(), key=lambda r: (r["lang"], r["_r"], r["text"])):
            if len(of := out[r["lang"]]) < DOCS:
                of.append(r["text"])
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; only the text is an input of the prediction.

    Null texts and texts without a letter are und with score 0. Repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = as_bytes(b.column(1))
        for i, j in slices(text, 2_000_000):
            langs, scores = shared.value.predict([x or b"" for x in text.slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with two more columns, which must not be among its own: the predicted language and its score.

    Null and empty texts and those without a letter are und with score 0, as are all if the model knows no language. Equal
    scores go to the language that comes first in the model. Repeated rows stay; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = as_bytes(b.column(b.schema.get_field_index("text")))
        for i, j in slices(text, 2_000_000):
            langs, scores = shared.value.predict([x or b"" for x in text.slice(i, j - i).to_pylist()])
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_as, score_as])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]))
