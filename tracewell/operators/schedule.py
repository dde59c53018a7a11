"""Placement policies: queues, round robin, earliest finish (HEFT) and sufferage (ERA)."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable
from heapq import nsmallest
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MAX, round_up


def queue_order(tasks: DataFrame, by: list[str], arrival: list[str]) -> DataFrame:
    """First in, first out: position from 1 within by."""
    return tasks.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*arrival)))


def by_memory(tasks: DataFrame, custom: DataFrame, by: list[str], arrival: list[str], default_mb: int, step_mb: int) -> DataFrame:
    """First in, first out for each size of container: custom memory by task name or the default, rounded up to a step."""
    memory = round_up(F.coalesce("custom_mb", F.lit(default_mb)), F.lit(step_mb))
    sized = tasks.join(custom.select("name", F.col("mb").alias("custom_mb")), "name", "left").withColumn("memory_mb", memory).drop("custom_mb")
    return queue_order(sized, [*by, "memory_mb"], arrival)


def round_robin(tasks: DataFrame, hosts: DataFrame, by: list[str], order: list[str], host: str) -> DataFrame:
    """Tasks in order (depth, then id) to hosts in turn; hosts in sorted order, a dimension table by nature.

    Raises ValueError if there are no hosts.
    """
    listed = hosts.select(host).distinct().withColumn("_at", F.row_number().over(Window.orderBy(host)) - 1)
    n = listed.count()
    if not n:
        raise ValueError("no hosts are known; a static policy needs some")
    placed = tasks.withColumn("_at", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % n)
    return placed.join(listed, "_at").drop("_at")


def heft_place(nodes: list[tuple], parents: dict, cost: Callable, containers: list[tuple], seed: int | None = None) -> list[tuple]:
    """(id, host, slot, start, finish) of nodes, given by falling upward rank: earliest finish with insertion.

    containers: (host, number). A gap fits if the cost is below its length. A task starts no earlier than its parents
    end. Of containers with equal ends the first is taken, or one by chance if there is a seed.
    """
    gaps = {c: [(0.0, MAX)] for c in containers}
    done: dict = {}
    out = []
    chance = Random(seed)
    for node in nodes:
        free = max((done.get(p, 0.0) for p in parents.get(node, ())), default=0.0)
        best: list[tuple] = []
        for c in containers:
            need = cost(node, c[0])
            for g in gaps[c]:
                start = max(free, g[0])
                if best and start + need > best[0][0]:
                    if g[0] >= free:
                        break  # later gaps of this container begin later still
                    continue
                if need < g[1] - start:  # a container's first fitting gap is its earliest
                    if best and start + need < best[0][0]:
                        best = []
                    best.append((start + need, c, g, start))
                    break
        end, c, g, start = best[0] if seed is None else chance.choice(best)
        gaps[c].remove(g)
        for left in ((g[0], start), (end, g[1])):
            if left[1] > left[0]:
                insort(gaps[c], left)
        done[node] = end
        out.append((node, c[0], c[1], start, end))
    return out


def heft(ranked: DataFrame, edges: DataFrame, costs: DataFrame, by: str, slots: int = 1, seed: int | None = None) -> DataFrame:
    """(by, id, host, slot, start, finish): one group per run, since each placement depends on those before.

    ranked: (by, id, name, upward_rank, depth); costs: (name, host, estimate). A task's row carries the costs of its own
    name; hosts, the nodes of a cluster, are listed on the driver. A run's graph is one workflow and fits a worker.
    Tasks go by falling upward rank, then depth, then id.
    """
    hosts = [r[0] for r in costs.select("host").distinct().orderBy("host").collect()]
    if not hosts:
        raise ValueError("no hosts are known; a static policy needs some")
    parents = edges.groupBy(by, F.col("b").alias("id")).agg(F.collect_list("a").alias("parents"))
    own = costs.groupBy("name").agg(F.collect_list("host").alias("_hosts"), F.collect_list(F.col("estimate").cast("double")).alias("_costs"))
    rows = ranked.join(parents, [by, "id"], "left").join(own, "name", "left")
    containers = [(h, i) for h in hosts for i in range(slots)]

    def place(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(["upward_rank", "depth", "id"], ascending=[False, True, True])
        names = dict(zip(run["id"], run["name"]))
        known = {n: dict(zip(h, c)) for n, h, c in zip(run["name"], run["_hosts"], run["_costs"]) if h is not None}
        up = {i: list(p) for i, p in zip(run["id"], run["parents"]) if p is not None}
        placed = heft_place(run["id"].tolist(), up, lambda i, h: known.get(names[i], {}).get(h, 0.0), containers, seed)
        return pd.DataFrame([(run[by].iloc[0], *p) for p in placed], columns=[by, "id", "host", "slot", "start", "finish"])

    kinds = {c: t for c, t in ranked.dtypes}
    host_type = dict(costs.dtypes)["host"]
    return rows.groupBy(by).applyInPandas(place, f"{by} {kinds[by]}, id {kinds['id']}, host {host_type}, slot int, start double, finish double")


def era_replay(ready: list[tuple], asks: list, estimate: Callable, replicas: int) -> list[tuple]:
    """Decisions for a sequence of asking hosts: (ask number, host, kind, task, is_replica).

    ready: (kind, task) in arrival order. Each ask takes the oldest ready task of the kind with the least sufferage; a
    kind without an estimate on the host is taken at once. When none is ready, running tasks are copied, up to
    `replicas` copies; a task is copied once at most. Kinds in sorted order; the first of equals wins.
    """
    queues: dict = {}
    for kind, task in ready:
        queues.setdefault(kind, deque()).append(task)
    hosts = sorted(set(asks))
    known: dict = {}

    def sufferage(kind, host, own: float, copy: bool) -> float:
        if (kind, copy) not in known:  # estimates don't change during a replay
            each = {h: e for h in hosts if (e := estimate(kind, h, copy)) != 0}
            known[kind, copy] = each, sum(each.values()), nsmallest(2, each.values())
        each, total, least = known[kind, copy]
        mine = each.get(host)
        others = len(each) - (mine is not None)
        if not others:
            return (own - MAX) / own
        other = least[1] if mine == least[0] else least[0]
        return (own - other) / ((own + total - (mine or 0.0)) / (others + 1))

    running: dict = {}
    copied: set = set()
    out = []
    for n, host in enumerate(asks):
        choice = {k: v for k, v in queues.items() if v}
        if copy := not choice:
            if len(copied) >= replicas:
                break  # nothing is ready, and nothing may be copied any more
            choice = {k: [t for t in v if t not in copied] for k, v in running.items()}
        best, lowest = None, MAX
        for kind in sorted(k for k, v in choice.items() if v):
            own = estimate(kind, host, copy)
            if own == 0:
                if not copy:
                    best = kind
                    break
                own = MAX
            s = sufferage(kind, host, own, copy)
            if s < lowest:
                best, lowest = kind, s
        if best is None:
            continue
        if copy:
            task = choice[best][0]
            copied.add(task)
        else:
            task = queues[best].popleft()
            running.setdefault(best, []).append(task)
        out.append((n, host, best, task, copy))
    return out


#: Policies by name; dataAware is an old name of the adaptive one.
POLICIES = {"greedy": queue_order, "memoryAware": by_memory, "staticRoundRobin": round_robin, "HEFT": heft, "ERA": era_replay, "dataAware": era_replay}
