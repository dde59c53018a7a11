"""The steps of logstats (cleaning, matching, folding) on Arrow batches that hold whole runs, as arrays of numpy.

The same results as logstats, for any entries, without a row of text for each entry: texts are codes into dictionaries
that are read once each, sorts are of numbers. by_runs() calls a step on whole runs of a DataFrame.
"""

from __future__ import annotations

import ctypes
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import schema as S
from .logstats import PHASES

TEXTS, LONGS = ["source", "run_id", "task_name", "lang", "file", "key", "value"], ["line_no", "timestamp", "task_id", "invoc_id"]
OWN = ["invoc_id", "task_id", "task_name", "lang"]
FIRST = np.iinfo(np.int64).min
#: Rows that a step gets at once, and the rest of the last run.
ROWS = 10_000


def _keep_freed() -> None:
    """Memory that a batch has freed stays with the process (glibc) for the next one, whose arrays are as large; otherwise
    the system takes it back and hands it out page by page again."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD, as large as it may be
    mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def by_runs(df: DataFrame, step: Callable[[pa.Table], pa.Table], schema: str, rows: int = ROWS, dealt: bool = False) -> DataFrame:
    """step of tables of whole runs (column source). dealt: runs lie in one partition each, their rows side by side."""
    if not dealt:
        df = df.repartition("source").sortWithinPartitions("source")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed()
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            run = t["source"].dictionary_encode("encode").combine_chunks().indices.to_numpy()
            ends = np.flatnonzero(run[1:] != run[:-1])
            if len(ends):
                yield from step(t.slice(0, int(ends[-1]) + 1)).to_batches()
                t = t.slice(int(ends[-1]) + 1)
            held, n = t.to_batches(), t.num_rows
        if n:
            yield from step(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(work, schema)


class Log:
    """Entries. Texts are codes, -1 for null; longs are numbers, with what is null beside them."""

    def __init__(self, columns: dict, nulls: dict, texts: dict):
        self.c, self.null, self.texts = columns, nulls, texts

    @staticmethod
    def of(t: pa.Table | Log) -> Log:
        if isinstance(t, Log):
            return Log(dict(t.c), dict(t.null), t.texts)
        c, null, texts = {}, {}, {}
        for name in TEXTS:
            a = t[name]
            a = (a.unify_dictionaries() if pa.types.is_dictionary(a.type) else pc.dictionary_encode(a)).combine_chunks()
            a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
            once = a.dictionary.dictionary_encode()  # equal texts have the same code
            codes = np.append(once.indices.fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int64)
            c[name] = codes[a.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
            texts[name] = once.dictionary
        for name in LONGS:
            a = t[name].cast(pa.int64())
            c[name], null[name] = a.fill_null(0).to_numpy(), a.is_null().to_numpy()
        return Log(c, null, texts)

    def take(self, rows: np.ndarray) -> Log:
        return Log({k: v[rows] for k, v in self.c.items()}, {k: v[rows] for k, v in self.null.items()}, self.texts)

    def among(self, name: str, *texts: str) -> np.ndarray:
        """Rows whose text is one of these."""
        return np.append(pc.is_in(self.texts[name], pa.array(texts)).to_numpy(zero_copy_only=False), False)[self.c[name]]

    def told(self, name: str, rows: np.ndarray | None = None) -> pa.Array:
        """The column, as it was."""
        v = self.c[name] if rows is None else self.c[name][rows]
        if name in self.texts:
            return self.texts[name].take(pa.array(v, mask=v < 0))
        return pa.array(v, mask=self.null[name] if rows is None else self.null[name][rows])

    def read(self, rows: np.ndarray, read: Callable[[str], object], of: type = np.int64, null: object = 0) -> tuple[np.ndarray, np.ndarray]:
        """read(value) of these rows, each text once, and where it isn't null."""
        codes = self.c["value"][rows]
        used = np.unique(codes)
        used = used[used >= 0]
        got = [read(x) for x in self.texts["value"].take(pa.array(used)).to_pylist()]
        out, there = np.full(len(self.texts["value"]) + 1, null, of), np.zeros(len(self.texts["value"]) + 1, bool)
        out[used], there[used] = [null if x is None else x for x in got], [x is not None for x in got]
        return out[codes], there[codes]

    def wholes(self, rows: np.ndarray, read: Callable[[str], int | None], before: str = "", after: str = "") -> tuple[np.ndarray, np.ndarray]:
        """read(value) of these rows. Where digits stand between these two texts it must give their number: these are read
        at once."""
        codes = self.c["value"][rows]
        used = np.unique(codes)
        used = used[used >= 0]
        texts = self.texts["value"].take(pa.array(used))
        usual = pc.match_substring_regex(texts, f"^{re.escape(before)}[0-9]{{1,18}}{re.escape(after)}$")
        plain = usual.to_numpy(zero_copy_only=False)
        out, there = np.zeros(len(self.texts["value"]) + 1, np.int64), np.zeros(len(self.texts["value"]) + 1, bool)
        out[used[plain]] = pc.cast(pc.utf8_slice_codeunits(texts.filter(usual), len(before), -len(after) or None), pa.int64()).to_numpy()
        there[used[plain]] = True
        got = [read(x) for x in texts.filter(pc.invert(usual)).to_pylist()]
        out[used[~plain]], there[used[~plain]] = [0 if x is None else x for x in got], [x is not None for x in got]
        return out[codes], there[codes]

    def time(self) -> np.ndarray:
        """Time stamps, null first."""
        return np.where(self.null["timestamp"], FIRST, self.c["timestamp"])


def _json(text: str, name: str) -> str | None:
    """A member of an object as text, as get_json_object gives it; null if there is none."""

    def refuse(x: str):
        raise ValueError(x)

    try:
        found = json.loads(text, parse_int=str, parse_float=str, parse_constant=refuse, object_pairs_hook=lambda x: dict(reversed([p for p in x if p[1] is not None])))
    except (ValueError, RecursionError):
        return None
    x = found.get(name) if isinstance(found, dict) else None
    return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _whole(text: str | None, bits: int) -> int | None:
    x = int(text) if text is not None and re.fullmatch(r"[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*", text) else None
    return x if x is not None and -(2 ** (bits - 1)) <= x < 2 ** (bits - 1) else None


def _real_time(text: str) -> int | None:
    return _whole(_json(text, "realTime"), 64)


def _double(text: str) -> float | None:
    t = text.strip()
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?", t):
        return float(t.rstrip("dDfF"))
    return float(t) if t.lower() in {"nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"} else None


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A number of 64 bits for each row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h += x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def in_order(*keys: np.ndarray) -> np.ndarray:
    """Rows by these numbers, the first ones first, equal ones as they are. One number of all of them and of the row is
    sorted, where 63 bits hold it."""
    n, bits = len(keys[0]), len(keys[0]).bit_length()
    low = [int(k.min()) for k in keys if n]
    many = [int(k.max()) - m + 1 for k, m in zip(keys, low)]
    if math.prod(many) << bits >= 1 << 63:
        return np.lexsort(keys[::-1])
    one = np.zeros(n, np.int64)
    for k, m, x in zip(keys, low, many):
        one = one * x + (k - m)
    one = np.sort(one << bits | np.arange(n))
    return one & ((1 << bits) - 1)


def last_of(group: np.ndarray, v: np.ndarray, there: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The last value of each group (0 to groups - 1, ascending) of those that are there, and where there is one."""
    g, v = group[there], v[there]
    ends = np.append(g[1:] != g[:-1], True)[: len(g)]
    out, known = np.zeros(groups, v.dtype), np.zeros(groups, bool)
    out[g[ends]], known[g[ends]] = v[ends], True
    return out, known


def cleaned(t: pa.Table | Log, without: Iterable[str] = ()) -> Log:
    """Entries in file order, without repeated ones and without containers that ended with an exit code other than 0. Adds
    type and container (-1: null). without: columns that aren't wanted afterwards."""
    log = Log.of(t)
    order = in_order(log.c["source"], log.c["line_no"])
    fields = [log.c[x] for x in ("source", *S.FIELDS)] + [log.null[x] for x in S.FIELDS if x in log.null]
    h = hashed(fields)[order]

    def repeated(rows: np.ndarray, near: np.ndarray | slice) -> tuple[np.ndarray, bool]:
        """Rows that are equal to the one before in this order; whether the rows said to be near all are."""
        a, b = rows[1:][near], rows[:-1][near]
        alike = np.ones(len(a), bool)
        for x in fields:
            alike &= x[a] == x[b]
        return a[alike], bool(alike.all())

    # sorted with their places in the lowest bits
    low = np.uint64((1 << len(h).bit_length()) - 1)
    placed = np.sort(h & ~low | np.arange(len(h), dtype=np.uint64))
    again, all_alike = repeated(order[(placed & low).astype(np.int64)], (placed[1:] ^ placed[:-1]) <= low)
    if not all_alike:  # two entries with the same hash: sort by the fields themselves
        again, _ = repeated(order[np.lexsort([x[order] for x in fields])], slice(None))
    once = np.ones(len(h), bool)
    once[again] = False

    events = np.append([bool(re.search(S.EVENT_PATTERN, x)) for x in log.texts["key"].to_pylist()], False).astype(bool)[log.c["key"]]
    at = np.flatnonzero(events)
    names, held = {S.REQUESTED: 0, S.ALLOCATED: 1, S.COMPLETED: 2}, {}
    kind, container, bad = (np.full(len(events), -1), np.full(len(events), -1), np.zeros(len(events), bool))
    kind[at] = log.read(at, lambda v: None if (x := _json(v, "type")) is None else names.get(x, 3), null=-1)[0]
    container[at] = log.read(at, lambda v: None if (x := _json(v, "container-id")) is None or _json(v, "type") is None else held.setdefault(x, len(held)), null=-1)[0]
    bad[at] = log.read(at, lambda v: _json(v, "type") == S.COMPLETED and _whole(_json(v, "exit-code"), 32) not in (None, 0), bool, False)[0]
    of = log.c["source"] * (len(held) + 1) + container
    ends = np.flatnonzero((kind == 1) & (container >= 0))
    gone = np.zeros(len(events), bool)
    gone[ends] = np.isin(of[ends], of[bad & (container >= 0)])
    log.c |= {"type": kind, "container": container}
    for c in without:
        log.c.pop(c), log.null.pop(c, None)
    return log.take(order[(once & ~bad & ~gone)[order]])


def expanded(log: Log) -> Log:
    """Cleaned entries whose engine events carry the invocation they belong to."""
    key = lambda k: log.among("key", k)
    push, took, kind = key(S.EXEC), key(S.TIME), log.c["type"]
    pop, begun, ended = kind == 0, kind == 1, kind == 2
    told = np.full(len(push), -1)
    at = np.flatnonzero(push | took | (kind >= 0) & (kind < 3))
    n, run = len(at) + 1, log.c["source"][at]
    if not len(at):
        return log
    new = np.append(True, run[1:] != run[:-1])
    first, rank = np.maximum.accumulate(np.where(new, np.arange(n - 1), 0)), np.cumsum(new)

    def upto(v: np.ndarray) -> np.ndarray:
        """Running sums within runs."""
        s = np.cumsum(v)
        return s - (s - v)[first]

    def match(givers: np.ndarray, takers: np.ndarray) -> None:
        """The n-th of those that take has the n-th of those that give."""
        of = lambda side: (rank * n + upto(side))[side]
        there, wanted = of(givers), of(takers)
        found = np.minimum(np.searchsorted(there, wanted), max(len(there) - 1, 0))
        if len(there):
            told[at[takers]] = np.where(there[found] == wanted, at[givers][found], -1)

    step = push[at].astype(np.int64) - pop[at]
    before = upto(step) - step
    low = np.minimum.accumulate(before - rank * 2 * n) + rank * 2 * n
    match(push[at], pop[at] & (before - low > 0))
    match(took[at], ended[at])
    # a completion stands where its run time does; an allocation before it, without another one between, belongs to it
    held = np.flatnonzero((log.c["container"] >= 0) & (begun | ended & (told >= 0)))
    when = log.c["line_no"][np.where(ended[held], told[held], held)]
    held = held[np.lexsort((when, log.c["container"][held], log.c["source"][held]))]
    a, b = held[:-1], held[1:]
    mine = begun[a] & ended[b] & (log.c["container"][a] == log.c["container"][b]) & (log.c["source"][a] == log.c["source"][b])
    told[a[mine]] = told[b[mine]]
    to = np.flatnonzero(told >= 0)
    out = Log(dict(log.c), dict(log.null), log.texts)
    for c in (c for c in OWN if c in log.c):
        there = (log.c[c][told[to]] >= 0) if c in log.texts else ~log.null[c][told[to]]
        out.c[c] = log.c[c].copy()
        out.c[c][to[there]] = log.c[c][told[to[there]]]
        if c in log.null:
            out.null[c] = log.null[c].copy()
            out.null[c][to[there]] = False
    return out


def matches(t: pa.Table | Log) -> pa.Table:
    """Engine events with the invocations they are matched to."""
    log = expanded(cleaned(t))
    rows = np.flatnonzero(log.c["type"] >= 0)
    return pa.table({c: log.told(c, rows) for c in ("source", "line_no", "invoc_id", "task_name")})


def folded(log: Log) -> tuple[np.ndarray, np.ndarray, Callable, dict[str, np.ndarray]]:
    """Entries of invocations (expanded) by run, invocation and time; where each invocation begins among them; what tells the
    last value of each among some of them; the phases."""
    own = np.flatnonzero(~log.null["invoc_id"])
    # entries are in file order, which equal times keep
    own = own[in_order(log.c["source"][own], log.c["invoc_id"][own], log.time()[own])]
    run, invoc = log.c["source"][own], log.c["invoc_id"][own]
    new = np.append(True, (run[1:] != run[:-1]) | (invoc[1:] != invoc[:-1]))[: len(run)]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    key, kind = log.c["key"][own], log.c["type"][own]

    def with_key(k: str) -> np.ndarray:
        return np.flatnonzero(np.append(pc.equal(log.texts["key"], k).to_numpy(zero_copy_only=False), False)[key])

    def last(at: np.ndarray, v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last value of each invocation, and where there is one."""
        return last_of(group[at], v, there, len(first))

    def time(at: np.ndarray) -> np.ndarray:
        return last(at, log.c["timestamp"][own[at]], ~log.null["timestamp"][own[at]])[0]

    def real(at: np.ndarray) -> np.ndarray:
        return last(at, *log.wholes(own[at], _real_time, '{"realTime":"', '"}'))[0]

    asked, came, ran, went = (with_key(k) for k in (S.TIME_SCHED, S.TIME_STAGE_IN, S.TIME, S.TIME_STAGE_OUT))
    sched, stage_out = real(asked), real(went)
    phases = {
        "sched": sched, "startup": time(came) - time(np.flatnonzero(kind == 1)) - sched, "stage_in": real(came), "exec": real(ran),
        "stage_out": stage_out, "shutdown": time(np.flatnonzero(kind == 2)) - time(went) - stage_out,
    }
    return own, first, last, phases


def invocations(t: pa.Table | Log) -> pa.Table:
    """One row for each run and invocation with its host, phases and product of input sizes (1.0 without files)."""
    log = expanded(cleaned(t))
    own, first, last, phases = folded(log)
    host, ran, sizes = (np.flatnonzero(log.among("key", k)[own]) for k in (S.HOST, S.TIME, S.FILE_SIZE_IN))
    hosts, has_host = last(host, log.c["value"][own[host]], log.c["value"][own[host]] >= 0)
    exec_ts, has_exec = last(ran, log.c["timestamp"][own[ran]], ~log.null["timestamp"][own[ran]])
    product = np.ones(len(first))
    np.multiply.at(product, np.searchsorted(first, sizes, side="right") - 1, log.read(own[sizes], _double, float, 1.0)[0])
    return pa.table(
        {c: log.told(c, own[first]) for c in ("source", "invoc_id", "task_name")}
        | {"host": log.texts["value"].take(pa.array(hosts.astype(np.int64), mask=~has_host)), "exec_ts": pa.array(exec_ts, mask=~has_exec), "file_size": product}
        | phases
    )


def statistics(t: pa.Table | Log) -> pa.Table:
    """One row for each run with invocations: phases, containers at once at most, run time, time without a ready task, idle
    time."""
    log = expanded(cleaned(t, ["run_id", "task_id", "task_name", "lang", "file"]))
    own, each, _, phases = folded(log)
    # all entries in the order of time, ties in file order
    order = in_order(log.c["source"], log.time())
    run, ts, unknown, kind = log.c["source"][order], log.c["timestamp"][order], log.null["timestamp"][order], log.c["type"][order]
    new = np.append(True, run[1:] != run[:-1])[: len(run)]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1

    def upto(v: np.ndarray) -> np.ndarray:
        """Running sums within runs."""
        s = np.cumsum(v)
        return s - (s - v)[first][group]

    def latest(rows: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
        """What the last of these rows tells in each run, 0 if there is none or it can't be read."""
        return last_of(group[rows], np.where(there, v, 0), np.ones(len(rows), bool), len(first))[0]

    begun, ended = (kind == 1).astype(np.int64), (kind == 2).astype(np.int64)
    named, took, asked = (log.among("key", k)[order] for k in (S.WF_NAME, S.WF_TIME, S.EXEC))
    named, took = np.flatnonzero(named), np.flatnonzero(took)
    onset, runtime = latest(named, ts[named], ~unknown[named]), latest(took, *log.wholes(order[took], lambda v: _whole(v, 64)))
    most = np.maximum(np.maximum.reduceat(upto(begun - ended), first), 0)
    since = np.where(new | np.append(True, unknown[:-1])[: len(run)], onset[group], np.append(0, ts[:-1])[: len(run)])
    waited = np.maximum(most[group] - upto(asked - ended), 0) * (ts - since)
    none_ready, known = np.add.reduceat(np.where(unknown, 0, waited), first), np.logical_or.reduceat(~unknown, first)
    # runs that have invocations
    of = np.searchsorted(run[first], log.c["source"][own[each]])
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    runs, n = of[begins], np.diff(np.append(begins, len(of)))
    means = {p: pc.divide(pa.array(np.add.reduceat(v, begins)), pa.array(n)) for p, v in phases.items()}
    idle = (most * runtime - none_ready)[runs] - sum(m.to_numpy() for m in means.values())
    return pa.table(
        {"source": log.told("source", order[first[runs]]), "invocations": n} | means
        | {"max_concurrent": most[runs], "runtime": runtime[runs], "no_task_ready": pa.array(none_ready[runs], mask=~known[runs]), "idle": pa.array(idle, mask=~known[runs])}
    )


def report(t: pa.Table | Log) -> pa.Table:
    """One row for each run and task name with the average phases, cut off towards 0; sorted within the table."""
    sums = invocations(t).group_by(["source", "task_name"]).aggregate([([], "count_all"), *((p, "sum") for p in PHASES)])
    sums = sums.sort_by([("source", "ascending"), ("task_name", "ascending")])
    n = sums["count_all"].cast(pa.int64())
    return pa.table({"source": sums["source"], "task_name": sums["task_name"], "invocations": n} | {p: pc.divide(sums[f"{p}_sum"], n) for p in PHASES})


def wide_report(t: pa.Table | Log, names: list[str]) -> pa.Table:
    """One row for each run, six columns for each of these names."""
    r = report(t)
    runs = r["source"].combine_chunks().dictionary_encode("encode")
    at, out = runs.indices.to_numpy(), {"source": runs.dictionary}
    for name in names:
        rows = np.flatnonzero(pc.equal(r["task_name"], name).fill_null(False).to_numpy())
        where = np.full(len(runs.dictionary), -1)
        where[at[rows]] = rows
        out |= {f"{name}_{p}": r[p].combine_chunks().take(pa.array(where, mask=where < 0)) for p in PHASES}
    return pa.table(out)


def in_time_order(t: pa.Table | Log, least: int) -> pa.Table:
    """The first entries of each run in the order of time, ties in the order of the file."""
    log = cleaned(t)
    order = np.lexsort((log.time(), log.c["source"]))
    run = log.c["source"][order]
    new = np.append(True, run[1:] != run[:-1])[: len(run)]
    n = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    return pa.table({c: log.told(c, order[n < least]) for c in ("source", "line_no")})
