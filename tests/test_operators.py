"""Ordered scans, estimates, graphs, placement and scalars against plain sequential versions."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.operators import estimate, graph, ordered, schedule

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
events = st.lists(st.sampled_from("epz"), min_size=1, max_size=60)


@FEW
@given(kinds=events)
def test_skip_match(spark, kinds):
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run string, n long, kind string")
    got = {(r.push_n, r.pop_n) for r in ordered.skip_match(df.withColumnRenamed("n", "n0").withColumn("n", F.col("n0")).drop("n0").withColumnRenamed("n", "at"), ["run"], ["at"], F.col("kind") == "e", F.col("kind") == "p", ["at"]).select(F.col("push_at").alias("push_n"), F.col("pop_at").alias("pop_n")).collect()}
    queue, want = [], set()
    for i, k in enumerate(kinds):
        if k == "e":
            queue.append(i)
        elif k == "p" and queue:
            want.add((queue.pop(0), i))
    assert got == want


@FEW
@given(kinds=events)
def test_concurrency_and_shortage(spark, kinds):
    df = spark.createDataFrame([("r", i, i * i, k) for i, k in enumerate(kinds)], "run string, at long, ts long, kind string")
    step = F.when(F.col("kind") == "e", 1).when(F.col("kind") == "p", -1).otherwise(0)
    now = most = total = 0
    last = -3
    for i, k in enumerate(kinds):
        now += {"e": 1, "p": -1}.get(k, 0)
        most = max(most, now)
        total += max(0, 2 - now) * (i * i - last)
        last = i * i
    assert ordered.max_concurrency(df, ["run"], ["at"], step).first()[1] == most
    assert ordered.shortage_integral(df, ["run"], ["at"], F.col("ts"), F.lit(-3), step, F.lit(2), "x").first()[1] == total


def test_positional_and_latest(spark):
    df = spark.createDataFrame([("r", 1, "b", "x"), ("r", 2, "b", "y"), ("r", 3, "e", "z"), ("r", 4, "e", "w"), ("r", 5, "e", "v")], "run string, at long, kind string, v string")
    got = {(r.left_v, r.right_v) for r in ordered.positional_match(df, ["run"], ["at"], F.col("kind") == "b", F.col("kind") == "e", ["v"]).collect()}
    assert got == {("x", "z"), ("y", "w")}
    assert {r.begin_v for r in ordered.latest_before(df, ["run"], ["at"], F.col("kind") == "b", F.col("kind") == "e", ["v"]).collect()} == {"y"}


def test_fill_dedupe_increments(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, ""), ("r", 3, None), ("r", 4, "b")], "run string, at long, v string")
    assert [r.v for r in ordered.carry_forward(df, ["run"], [F.col("at")], ["v"]).orderBy("at").collect()] == ["a", "a", "a", "b"]
    assert ordered.first_occurrences(df.union(df), ["run", "v"], ["at"]).count() == 4
    assert [r.d for r in ordered.increments(df, ["run"], ["at"], {"d": "at"}).collect()] == [1, 1, 1]


MEASURED = [(0.0, 10.0), (100.0, 14.0), (400.0, 11.0), (900.0, 20.0)]


@pytest.mark.parametrize(
    ("rows", "alpha", "want"),
    [(MEASURED, 0.2, 17.208663066446835), (MEASURED, 0.5, 20.0), (MEASURED[:1], 0.5, 10.0), (MEASURED[:1], 0.2, 0.0), (MEASURED[:2], 0.2, 0.0), ([(0.0, 0.0)], 0.5, 2.2250738585072014e-308), ([(0.0, 10.0), (0.0, 12.0), (1.0, 13.0)], 0.2, 0.0)],
)
def test_wiener(spark, rows, alpha, want):
    df = spark.createDataFrame([("t", "h", i, ms, v) for i, (ms, v) in enumerate(rows)], "task string, host string, n int, ms double, real_time double")
    got = estimate.wiener_estimates(df, alpha, F.lit(1000.0), ["task", "host"], ["ms", "n"]).first()["estimate"]
    assert got == pytest.approx(want, abs=1e-9)


def test_sufferage(spark):
    m = spark.createDataFrame([("b1", "h1", 10.0), ("b1", "h2", 20.0), ("b2", "h1", 30.0), ("b2", "h2", 15.0)], "bot string, host string, estimate double")
    scored = estimate.sufferage(m, "bot", "host")
    got = {(r.bot, r.host): round(r.sufferage, 4) for r in scored.collect()}
    assert got == {("b1", "h1"): -0.6667, ("b2", "h1"): 0.6667, ("b1", "h2"): 0.6667, ("b2", "h2"): -0.6667}
    assert {(r.host, r.bot) for r in estimate.sufferage_picks(scored, "bot", "host").collect()} == {("h1", "b1"), ("h2", "b2")}
    new = m.withColumn("estimate", F.when(F.col("bot") == "b2", 0.0).otherwise(F.col("estimate")))
    assert {r.bot for r in estimate.sufferage_picks(estimate.sufferage(new, "bot", "host"), "bot", "host").collect()} == {"b2"}
    assert estimate.mean_cost(estimate.full_matrix(m, m, m, "bot", "host"), "bot").count() == 2


def dag(spark):
    nodes = spark.createDataFrame([("r", i, f"t{i}", float(c)) for i, c in zip((1, 2, 3, 4), (5, 3, 2, 1))], "run string, id long, name string, cost double")
    edges = spark.createDataFrame([("r", 1, 2), ("r", 2, 3), ("r", 1, 3), ("r", 3, 4)], "run string, a long, b long")
    return nodes, edges


def test_graph(spark):
    nodes, edges = dag(spark)
    assert {r.id: r.depth for r in graph.depths(nodes, edges, ["run"]).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.id: r.upward_rank for r in graph.upward_ranks(nodes, edges, ["run"]).collect()} == {1: 11.0, 2: 6.0, 3: 3.0, 4: 1.0}
    ends = {r.id: (r.is_root, r.is_leaf) for r in graph.roots_and_leaves(nodes, edges, ["run"]).collect()}
    assert ends == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True)}
    assert [r.id for r in graph.ready(nodes, edges, nodes.filter("id = 1"), ["run"]).collect()] == [2]


def test_cycle(spark):
    nodes, edges = dag(spark)
    cyclic = edges.union(spark.createDataFrame([("r", 4, 1)], edges.schema))
    for fits in (0, graph.FITS):
        with pytest.raises(Exception, match="cycle"):
            graph.longest(nodes, cyclic, ["run"], fits).collect()


def test_long_paths_are_no_cycles(spark):
    n = 11_000
    nodes = spark.range(n).select(F.lit("r").alias("run"), "id", F.lit(1.5).alias("cost"))
    edges = nodes.filter("id > 0").select("run", (F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert graph.longest(nodes, edges, ["run"]).agg(F.max("value")).first()[0] == 1.5 * n


def test_rounds_and_one_pass_agree(spark):
    import random

    rng = random.Random(5)
    rows = [(run, i, float(rng.randrange(9))) for run in range(4) for i in range(12)]
    links = [(run, a, b) for run in range(4) for b in range(12) for a in range(b) if rng.random() < 0.25] + [(0, 99, 3), (1, 2, 99)]
    nodes, edges = spark.createDataFrame(rows, "run long, id long, cost double"), spark.createDataFrame(links, "run long, a long, b long")
    got = [sorted(map(tuple, graph.longest(nodes, edges, ["run"], fits).collect())) for fits in (0, graph.FITS)]
    assert got[0] == got[1] and len(got[0]) == 48


def test_round_robin(spark):
    tasks = spark.createDataFrame([("r", i, i % 2) for i in range(5)], "run string, id long, depth int")
    hosts = spark.createDataFrame([("b",), ("a",)], "host string")
    got = {r.id: r.host for r in schedule.round_robin(tasks, hosts, ["run"], ["depth", "id"], "host").collect()}
    assert got == {0: "a", 2: "b", 4: "a", 1: "b", 3: "a"}
    with pytest.raises(ValueError, match="hosts"):
        schedule.round_robin(tasks, hosts.limit(0), ["run"], ["depth"], "host")


def test_by_memory(spark):
    tasks = spark.createDataFrame([("r", 1, "x"), ("r", 2, "y"), ("r", 3, "x")], "run string, id long, name string")
    custom = spark.createDataFrame([("x", 1500)], "name string, mb int")
    got = {r.id: (r.memory_mb, r.position) for r in schedule.by_memory(tasks, custom, ["run"], ["id"], 1024, 1024).collect()}
    assert got == {1: (2048, 1), 3: (2048, 2), 2: (1024, 1)}


def test_heft_places_by_earliest_finish(spark):
    nodes, edges = dag(spark)
    ranked = graph.upward_ranks(nodes, edges, ["run"]).join(graph.depths(nodes, edges, ["run"]), ["run", "id"]).join(nodes.select("run", "id", "name"), ["run", "id"])
    costs = spark.createDataFrame([(f"t{i}", h, c) for i in range(1, 5) for h, c in (("h1", 4.0), ("h2", 3.0))], "name string, host string, estimate double")
    got = {r.id: (r.host, r.start, r.finish) for r in schedule.heft(ranked, edges, costs, "run").collect()}
    assert got == {1: ("h2", 0.0, 3.0), 2: ("h2", 3.0, 6.0), 3: ("h2", 6.0, 9.0), 4: ("h2", 9.0, 12.0)}


def test_heft_fills_gaps_and_keeps_order():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(2, 12)
        parents = {i: [p for p in range(i) if rng.random() < 0.3] for i in range(n)}
        cost = {(i, h): rng.randrange(1, 9) for i in range(n) for h in "ab"}
        placed = {p[0]: p for p in schedule.heft_place(list(range(n)), parents, lambda i, h: cost[i, h], [("a", 0), ("a", 1), ("b", 0)])}
        assert len(placed) == n
        for i, (_, h, s, start, end) in placed.items():
            assert end - start == cost[i, h] and all(placed[p][4] <= start for p in parents[i])
            assert all(end <= q[3] or q[4] <= start for q in placed.values() if q[1:3] == (h, s) and q[0] != i)


def test_era_replay():
    cost = {("b1", "h1"): 10.0, ("b1", "h2"): 20.0, ("b2", "h1"): 30.0, ("b2", "h2"): 15.0}
    got = schedule.era_replay([("b1", 1), ("b2", 2)], ["h1", "h2", "h1", "h2"], lambda k, h, _: cost[k, h], 1)
    assert got[:2] == [(0, "h1", "b1", 1, False), (1, "h2", "b2", 2, False)]
    assert [g[4] for g in got[2:]] == [True]
    assert schedule.era_replay([], ["h1"], lambda k, h, _: 0.0, 1) == []


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("A", 66), ("tar", 114598), ("mProjectPP", 1164000493), ("", 1), ("né€😀", None)])
def test_java_task_id(spark, name, want):
    if want is None:
        h, data = 0, name.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[i : i + 2], "big")) % 2**32
        h = h - 2**32 if h >= 2**31 else h
        want = abs(h + 1)
    assert one(spark, scalar.java_task_id(F.col("x")), x=name) == want


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, scalar.round_up(x, F.lit(512)), x=513) == 1024
    assert one(spark, scalar.tool_name(x), x="a/b/c/d") == "c" and one(spark, scalar.tool_name(x), x="a/b") == "a/b"
    assert one(spark, scalar.underscored(x), x="a b\tc") == "a_b_c"
    assert one(spark, scalar.first_extension(x), x="a.tar.gz") == "tar.gz" and one(spark, scalar.first_extension(x), x="a") is None
    assert one(spark, scalar.base_name(x), x="/p/a.tar.gz") == "a.tar"
    assert one(spark, scalar.normalised(x), x="  a \n b ") == "a b"
    assert one(spark, scalar.env_pair(x), x="k=v=w").asDict() == {"name": "k", "value": "v=w"}
    assert one(spark, scalar.env_pair(x), x="k").value == ""
    assert one(spark, scalar.escape_backslashes(x), x="a\\b") == "a\\\\b"
    assert one(spark, scalar.with_path_suffix(x, ["in"]), x="cat $in ${in} $in.name $input") == "cat $in.path ${in.path} $in.name $input"
    assert one(spark, scalar.without_suffixes(x), x="$a.value $b.dataset") == "$a $b"
    assert one(spark, scalar.console_date(x), x=0) == "70/01/01 00:00:00"
    assert one(spark, scalar.clone_id(x, F.lit(5)), x="r" * 50) == "r" * 36 + "_5"
    assert one(spark, scalar.split_list(x), x="a, b") == ["a", "b"]
    assert scalar.normal_quantile(0.2) == pytest.approx(statistics.NormalDist().inv_cdf(0.2))
    assert one(spark, scalar.progress(x, F.lit(0)), x=1.0) == 0.0


def test_era_replay_equals_the_definition():
    rng = random.Random(8)
    for _ in range(40):
        kinds, hosts = ["k1", "k2", "k3"], ["a", "b", "c", "d"]
        cost = {(k, h): rng.choice([0.0, 0.0, 1.0, 2.0, 5.0]) for k in kinds for h in hosts}
        ready = [(rng.choice(kinds), i) for i in range(8)]
        asks = [rng.choice(hosts) for _ in range(11)]
        seen = sorted(set(asks))
        queues = {k: [t for q, t in ready if q == k] for k in kinds}
        running, copied, want = {}, set(), []
        for n, host in enumerate(asks):
            copy = not any(queues.values())
            if copy and len(copied) >= 2:
                continue
            pool = {k: [t for t in v if t not in copied] for k, v in running.items()} if copy else queues
            scores = []
            for k in sorted(k for k in pool if pool[k]):
                own = cost[k, host]
                others = [cost[k, h] for h in seen if h != host and cost[k, h]]
                if own == 0 and not copy:
                    scores.append((-float("inf"), k))
                    break
                own = own or scalar.MAX
                scores.append(((own - min(others, default=scalar.MAX)) / ((own + sum(others)) / (1 + len(others))), k))
            if not scores:
                continue
            k = min(scores)[1]
            t = pool[k][0]
            if copy:
                copied.add(t)
            else:
                queues[k].remove(t)
                running.setdefault(k, []).append(t)
            want.append((n, host, k, t, copy))
        assert schedule.era_replay(ready, asks, lambda k, h, _: cost[k, h], 2) == want
