"""The worked event log of FIXTURES.md as JSON lines."""

import json


def event(ts, kind, container=None, code=None, engine="engine-event"):
    value = {"type": kind} | ({"container-id": container} if container else {}) | ({} if code is None else {"exit-code": code})
    return {"timestamp": ts, "run_id": "r1", "key": engine, "value": value}


def entry(ts, invoc, key, value, file=None):
    out = {"timestamp": ts, "run_id": "r1", "task_id": 66, "task_name": "A", "lang": "bash", "invoc_id": invoc, "key": key, "value": value}
    return out | ({"file": file} if file else {})


def took(ms):
    return {"realTime": str(ms)}


LOG = [
    {"timestamp": 1000, "run_id": "r1", "key": "wf-name", "value": "demo"},
    entry(1010, 1, "invoc-exec", "x"), entry(1010, 2, "invoc-exec", "x"),
    event(1020, "container-requested"), event(1021, "container-requested"), event(1030, "container-requested"),
    event(1100, "container-allocated", "c1"), event(1100, "container-allocated", "c2"), event(1200, "container-allocated", "c3"),
    event(1300, "container-completed", "c3", -100), event(2000, "container-completed", "c1", 0),
    entry(1105, 1, "invoc-time-sched", took(5)), entry(1105, 1, "invoc-host", "h1"),
    entry(1150, 1, "invoc-time-stagein", took(20)), entry(1150, 1, "file-size-stagein", "10", "a.txt"), entry(1150, 1, "file-size-stagein", "3", "b.txt"),
    entry(1900, 1, "invoc-time-stageout", took(30)), entry(2001, 1, "invoc-time", took(900)), entry(2001, 1, "invoc-time", took(900)),
    event(2600, "container-completed", "c2", 0),
    entry(1106, 2, "invoc-time-sched", took(6)), entry(1106, 2, "invoc-host", "h2"),
    entry(1160, 2, "invoc-time-stagein", took(25)), entry(1160, 2, "file-size-stagein", "10", "a.txt"),
    entry(2400, 2, "invoc-time-stageout", took(50)), entry(2601, 2, "invoc-time", took(1500)),
    {"timestamp": 2700, "run_id": "r1", "key": "wf-time", "value": "1700"},
]


def write(path, log=LOG):
    path.write_text("".join(json.dumps(e) + "\n" for e in log))
    return str(path)
