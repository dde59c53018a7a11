"""Queries over the given tables, one for each family of operators, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import normal_quantile
from ..operators import estimate, graph, ordered, schedule
from ..sources import logs
from ..streaming import live
from . import logstats, provenance
from .tables import graph as task_graph
from .tables import invocations, micros, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
Z20 = normal_quantile(0.2)
HOUR = 3_600_000.0

#: Start of SQL texts: events as invocations, and a run time estimate for each task and host.
INV = "inv AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id AS invoc_id, event_type AS task, user_id AS host, epoch_us(ts) AS us, epoch_us(ts) / 1000.0 AS ms, value AS real_time, props FROM events)"
STEPS = f"{INV}, diffs AS (SELECT *, ms - lag(ms) OVER w AS dt, real_time - lag(real_time) OVER w AS dr FROM inv WINDOW w AS (PARTITION BY task, host ORDER BY us, invoc_id)), groups AS (SELECT task, host, arg_max(real_time, us) AS last_value, max(ms) AS last_ms, var_samp(CASE WHEN dt > 0 THEN dr / sqrt(dt) END) AS variance, count(CASE WHEN dt > 0 THEN 1 END) AS steps FROM diffs GROUP BY task, host)"
GRAPH = "nodes AS (SELECT p_partkey AS id, p_type AS name, CAST(p_size AS DOUBLE) AS cost FROM part WHERE p_partkey >= 1), edges AS (SELECT DISTINCT a, b FROM (SELECT id // 2 AS a, id AS b FROM nodes WHERE id > 1 UNION ALL SELECT id // 3, id FROM nodes WHERE id > 1) WHERE a >= 1)"


def walked(now: str) -> str:
    return f"CASE WHEN steps < 2 THEN 0.0 WHEN variance * ({now} - last_ms) > 0 THEN greatest(0.0, last_value + ({Z20!r}) * sqrt(variance * ({now} - last_ms))) ELSE greatest(0.0, last_value) END"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _estimates(spark: SparkSession, sf_dir: str, alpha: float = 0.2) -> DataFrame:
    return estimate.wiener_estimates(invocations(spark, sf_dir), alpha, F.col("last_ms") + HOUR, ["task", "host"], ["us", "invoc_id"])


# estimates


@query(f"WITH {STEPS} SELECT task, host, round({walked(f'(last_ms + {HOUR})')}, 6) AS estimate FROM groups")
def wiener_estimate_q20(spark, sf_dir):
    return _estimates(spark, sf_dir).select("task", "host", *six("estimate"))


@query(f"WITH {STEPS}, t AS (SELECT max(ms) + {HOUR} AS now_ms FROM inv) SELECT task, host, round({walked('now_ms')}, 6) AS estimate FROM groups, t")
def wiener_estimate_common_now(spark, sf_dir):
    rows = invocations(spark, sf_dir)
    now = rows.agg(F.max("ms")).first()[0] or 0.0
    return estimate.wiener_estimates(rows, 0.2, F.lit(now + HOUR), ["task", "host"], ["us", "invoc_id"]).select("task", "host", *six("estimate"))


@query(f"WITH {INV} SELECT task, host, round(greatest(arg_max(real_time, us), 2.2250738585072014e-308), 6) AS estimate FROM inv GROUP BY task, host")
def wiener_estimate_median(spark, sf_dir):
    return _estimates(spark, sf_dir, 0.5).select("task", "host", *six("estimate"))


MATRIX = f"{STEPS}, est AS (SELECT task, host, {walked(f'(last_ms + {HOUR})')} AS e FROM groups), m AS (SELECT t.task, h.host, coalesce(e, 0.0) AS e FROM (SELECT DISTINCT task FROM inv) t CROSS JOIN (SELECT DISTINCT host FROM inv) h LEFT JOIN est ON est.task = t.task AND est.host = h.host)"


def _matrix(spark, sf_dir):
    rows = invocations(spark, sf_dir)
    return estimate.full_matrix(_estimates(spark, sf_dir).select("task", "host", "estimate"), rows, rows, "task", "host")


@query(f"WITH {MATRIX} SELECT task, host, round(e, 6) AS estimate FROM m")
def task_host_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("task", "host", *six("estimate"))


@query(f"WITH {MATRIX} SELECT task, round(avg(e), 6) AS mean_cost FROM m GROUP BY task")
def mean_task_cost(spark, sf_dir):
    return estimate.mean_cost(_matrix(spark, sf_dir), "task").select("task", *six("mean_cost"))


@query(
    f"WITH {MATRIX}, k AS (SELECT task, host, CASE WHEN e <> 0 THEN e END AS e FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY e NULLS LAST, host) AS rk, sum(e) OVER (PARTITION BY task) AS s, count(e) OVER (PARTITION BY task) AS n FROM k), "
    "x AS (SELECT *, min(CASE WHEN rk = 1 THEN e END) OVER (PARTITION BY task) AS e1, min(CASE WHEN rk = 2 THEN e END) OVER (PARTITION BY task) AS e2 FROM r), "
    "y AS (SELECT host, task, CASE WHEN e IS NOT NULL THEN (e - coalesce(CASE WHEN rk = 1 THEN e2 ELSE e1 END, 1.7976931348623157e308)) / (s / n) END AS suff FROM x), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY suff NULLS FIRST, task) AS n FROM y) SELECT host, task, suff IS NULL AS unexplored FROM z WHERE n = 1"
)
def era_sufferage_pick(spark, sf_dir):
    picks = estimate.sufferage_picks(estimate.sufferage(_matrix(spark, sf_dir), "task", "host"), "task", "host")
    return picks.select("host", "task", F.col("sufferage").isNull().alias("unexplored"))


@query(f"WITH {INV} SELECT host, max(us) AS high_water_mark FROM inv GROUP BY host")
def host_high_water_mark(spark, sf_dir):
    return estimate.replayed_marks(invocations(spark, sf_dir), "host", "us")


# provenance interface: orders are runs, lineitem invocations, part tasks


def _store(spark, sf_dir) -> provenance.Store:
    li = read(spark, sf_dir, "lineitem")
    inv = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("invoc_id"), F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("host"), micros("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("real_time"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("wf_name"))
    return provenance.Store(inv, runs, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("task_name")))


@query("SELECT DISTINCT l_suppkey AS host FROM lineitem WHERE l_suppkey IS NOT NULL")
def host_names(spark, sf_dir):
    return _store(spark, sf_dir).host_names()


@query("SELECT DISTINCT l_partkey AS task_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_partkey <> 0")
def task_ids_for_workflow(spark, sf_dir):
    return _store(spark, sf_dir).task_ids_for_workflow("1-URGENT")


@query("SELECT p_partkey AS task_id, p_name AS task_name FROM part WHERE p_partkey = 7")
def task_name_lookup(spark, sf_dir):
    return _store(spark, sf_dir).task_name(7)


@query("SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS invoc_id, l_partkey AS task_id, l_suppkey AS host, epoch_us(l_shipdate) AS \"timestamp\", l_quantity AS real_time FROM lineitem WHERE l_partkey IN (3, 7, 11) AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL")
def invocations_for_tasks(spark, sf_dir):
    return _store(spark, sf_dir).entries_for_tasks([3, 7, 11])


def _since(inclusive: bool):
    def run(spark, sf_dir):
        rows = invocations(spark, sf_dir).select("run_id", "invoc_id", F.when(F.col("task") == "click", 1).otherwise(2).alias("task_id"), "host", F.col("us").alias("timestamp"), "real_time")
        return provenance.Store(rows, rows, rows).entries_on_host_since(1, 8, 1_704_500_000_000_000, inclusive)

    return run


SINCE = f"WITH {INV} SELECT run_id, invoc_id, 1 AS task_id, host, us AS \"timestamp\", real_time FROM inv WHERE task = 'click' AND host = 8 AND real_time IS NOT NULL AND us "
for _name, _inclusive in (("invocations_on_host_since", False), ("invocations_on_host_since_inclusive", True)):
    QUERIES[_name] = _since(_inclusive)
    SQL[_name] = SINCE + (">= " if _inclusive else "> ") + "1704500000000000"


@query("SELECT l_orderkey AS run_id, count(*) AS complete FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey <> 0 AND l_quantity IS NOT NULL GROUP BY l_orderkey")
def complete_invocations(spark, sf_dir):
    return _store(spark, sf_dir).invocations.filter(provenance.complete()).groupBy("run_id").agg(F.count("*").alias("complete"))


@query("SELECT s_suppkey AS host FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_orderkey % 50 = 7 AND l_returnflag = 'R'")
def new_hosts_except(spark, sf_dir):
    known = read(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 7 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("host")).distinct()
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host")).distinct().join(known, "host", "left_anti")


@query(f"WITH {INV} SELECT host, count(*) FILTER (WHERE run_id <> '2024-01-30') AS earlier, count(*) AS invocations FROM inv GROUP BY host")
def prior_run_count(spark, sf_dir):
    return invocations(spark, sf_dir).groupBy("host").agg(F.count_if(F.col("run_id") != "2024-01-30").alias("earlier"), F.count("*").alias("invocations"))


@query("SELECT o_orderpriority AS wf_name, count(*) AS runs FROM orders GROUP BY o_orderpriority")
def runs_per_workflow(spark, sf_dir):
    return _store(spark, sf_dir).runs.groupBy("wf_name").agg(F.count("*").alias("runs"))


FILES = "files AS (SELECT l_orderkey AS run_id, l_linenumber AS invoc_id, CAST(l_partkey AS VARCHAR) AS file, max(l_quantity) AS size, max(CASE WHEN l_returnflag <> 'N' THEN l_tax END) AS t_in, max(CASE WHEN l_returnflag <> 'R' THEN l_tax END) AS t_out FROM lineitem GROUP BY ALL)"


def _files(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("file", F.col("l_partkey").cast("string"))
    keys = [F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("invoc_id"), "file"]
    return rows.groupBy(*keys).agg(F.max("l_quantity").cast("long").alias("size"), F.max(F.when(F.col("l_returnflag") != "N", (F.col("l_tax") * 100).cast("long"))).alias("real_time_in"), F.max(F.when(F.col("l_returnflag") != "R", (F.col("l_tax") * 100).cast("long"))).alias("real_time_out"))


@query(f"WITH {FILES} SELECT run_id, invoc_id, count(*) FILTER (WHERE t_in IS NOT NULL) AS inputs, count(*) FILTER (WHERE t_out IS NOT NULL) AS outputs, CAST(sum(CASE WHEN t_in IS NOT NULL THEN size ELSE 0 END) AS BIGINT) AS input_bytes FROM files GROUP BY run_id, invoc_id")
def direction_split(spark, sf_dir):
    f = provenance.split_direction(_files(spark, sf_dir))
    return f.groupBy("run_id", "invoc_id").agg(F.count_if("is_input").alias("inputs"), F.count_if("is_output").alias("outputs"), F.sum(F.when(F.col("is_input"), F.col("size")).otherwise(0)).alias("input_bytes"))


@query(f"WITH {FILES} SELECT run_id, invoc_id, file, CAST(size AS BIGINT) AS size FROM files WHERE t_in IS NOT NULL")
def nested_file_stats(spark, sf_dir):
    nested = provenance.nested_files(_files(spark, sf_dir))
    return nested.select("run_id", "invoc_id", F.explode("input").alias("file", "stat")).select("run_id", "invoc_id", "file", F.col("stat.size").alias("size"))


# ordered scans; each run (day) is a partition


@query("WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM d WHERE n = 1")
def dedupe_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same"))
    return ordered.first_occurrences(docs, ["same"], ["doc_id"]).select("doc_id")


ORD = ["us", "invoc_id"]


@query(f"WITH {INV}, a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS n FROM inv WHERE task = 'view'), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS n FROM inv WHERE task = 'click') SELECT a.run_id, a.invoc_id AS completed, b.invoc_id AS invocation FROM a JOIN b ON a.run_id = b.run_id AND a.n = b.n")
def fifo_positional_match(spark, sf_dir):
    got = ordered.positional_match(invocations(spark, sf_dir), ["run_id"], ORD, F.col("task") == "view", F.col("task") == "click", ["invoc_id"])
    return got.select("run_id", F.col("left_invoc_id").alias("completed"), F.col("right_invoc_id").alias("invocation"))


@query(
    f"WITH {INV}, s AS (SELECT run_id, invoc_id, us, task = 'click' AS push, sum(CASE WHEN task = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS s FROM inv WHERE task IN ('click', 'view')), "
    "l AS (SELECT *, coalesce(lag(s) OVER w, 0) AS b, least(0, coalesce(min(s) OVER (PARTITION BY run_id ORDER BY us, invoc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s WINDOW w AS (PARTITION BY run_id ORDER BY us, invoc_id)), "
    "p AS (SELECT run_id, invoc_id, row_number() OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS n FROM l WHERE push), q AS (SELECT run_id, invoc_id, row_number() OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS n FROM l WHERE NOT push AND b - low > 0) "
    "SELECT p.run_id, p.invoc_id AS exec, q.invoc_id AS request FROM p JOIN q ON p.run_id = q.run_id AND p.n = q.n"
)
def fifo_skip_match(spark, sf_dir):
    got = ordered.skip_match(invocations(spark, sf_dir), ["run_id"], ORD, F.col("task") == "click", F.col("task") == "view", ["invoc_id"])
    return got.select("run_id", F.col("push_invoc_id").alias("exec"), F.col("pop_invoc_id").alias("request"))


DELTA = "CASE task WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END"


def _delta():
    return F.when(F.col("task") == "click", 1).when(F.col("task") == "view", -1).otherwise(0)


RUNNING = f"{INV}, c AS (SELECT *, sum({DELTA}) OVER (PARTITION BY run_id ORDER BY us, invoc_id) AS c FROM inv), mx AS (SELECT run_id, greatest(max(c), 0) AS max_concurrent FROM c GROUP BY run_id)"


@query(f"WITH {RUNNING} SELECT run_id, CAST(max_concurrent AS BIGINT) AS max_concurrent FROM mx")
def max_concurrency(spark, sf_dir):
    return ordered.max_concurrency(invocations(spark, sf_dir), ["run_id"], ORD, _delta())


SHORT = f"{RUNNING}, r AS (SELECT c.run_id, us - coalesce(lag(us) OVER (PARTITION BY c.run_id ORDER BY us, invoc_id), us) AS dt, sum(CASE task WHEN 'signup' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY c.run_id ORDER BY us, invoc_id) AS ready, max_concurrent FROM c JOIN mx ON c.run_id = mx.run_id), w AS (SELECT run_id, CAST(sum(greatest(0, max_concurrent - ready) * dt) AS BIGINT) AS no_task_ready_us FROM r GROUP BY run_id)"


def _shortage(spark, sf_dir):
    rows = invocations(spark, sf_dir)
    step = F.when(F.col("task") == "signup", 1).when(F.col("task") == "view", -1).otherwise(0)
    rows = rows.join(max_concurrency(spark, sf_dir), "run_id")
    return ordered.shortage_integral(rows, ["run_id"], ORD, F.col("us"), F.col("us"), step, F.col("max_concurrent"), "no_task_ready_us")


@query(f"WITH {SHORT} SELECT run_id, no_task_ready_us FROM w")
def no_task_ready_integral(spark, sf_dir):
    return _shortage(spark, sf_dir)


PH = "CAST(l_quantity AS BIGINT) AS sched, CAST(round(l_discount * 100) AS BIGINT) AS startup, CAST(round(l_tax * 100) AS BIGINT) AS stage_in, CAST(round(l_extendedprice) AS BIGINT) AS exec"
PHASES = ["sched", "startup", "stage_in", "exec"]


def _phases(spark, sf_dir):
    q, long = F.col, "long"
    return read(spark, sf_dir, "lineitem").select(q("l_orderkey").alias("run_id"), q("l_partkey"), q("l_quantity").cast(long).alias("sched"), F.round(q("l_discount") * 100).cast(long).alias("startup"), F.round(q("l_tax") * 100).cast(long).alias("stage_in"), F.round("l_extendedprice").cast(long).alias("exec"))


AVG = "count(*) AS invocations, " + ", ".join(f"CAST(sum({p}) // count(*) AS BIGINT) AS {p}" for p in PHASES)


@query(f"SELECT run_id, {AVG} FROM (SELECT l_orderkey AS run_id, {PH} FROM lineitem) GROUP BY run_id")
def phase_breakdown_total(spark, sf_dir):
    return logstats.averages(_phases(spark, sf_dir), ["run_id"], PHASES)


@query(f"SELECT task_name, {AVG} FROM (SELECT p_name AS task_name, {PH} FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY task_name")
def phase_breakdown_by_task(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("task_name"))
    return logstats.averages(_phases(spark, sf_dir).join(part, "l_partkey"), ["task_name"], PHASES)


@query(f"WITH {INV}, d AS (SELECT task, host, invoc_id, lead(real_time) OVER w - real_time AS exec_increment, lead(us) OVER w - us AS us_increment FROM inv WINDOW w AS (PARTITION BY task, host ORDER BY us, invoc_id)) SELECT task, host, invoc_id, round(exec_increment, 6) AS exec_increment, us_increment FROM d WHERE us_increment IS NOT NULL")
def exec_increments(spark, sf_dir):
    got = ordered.increments(invocations(spark, sf_dir), ["task", "host"], ORD, {"exec_increment": "real_time", "us_increment": "us"})
    return got.select("task", "host", "invoc_id", *six("exec_increment"), "us_increment")


@query(f"WITH {INV}, b AS (SELECT run_id, invoc_id, us, host, task, last_value(CASE WHEN task = 'signup' THEN invoc_id END IGNORE NULLS) OVER (PARTITION BY run_id, host ORDER BY us, invoc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begin_invoc_id FROM inv WHERE task IN ('signup', 'purchase')) SELECT run_id, host, begin_invoc_id, invoc_id FROM b WHERE task = 'purchase' AND begin_invoc_id IS NOT NULL")
def latest_allocation_match(spark, sf_dir):
    got = ordered.latest_before(invocations(spark, sf_dir), ["run_id", "host"], ORD, F.col("task") == "signup", F.col("task") == "purchase", ["invoc_id"])
    return got.select("run_id", "host", "begin_invoc_id", "invoc_id")


@query(f"WITH {INV} SELECT run_id, invoc_id, coalesce(CASE WHEN task = 'signup' THEN props END, last_value(CASE WHEN task = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY us, invoc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS name FROM inv")
def carry_forward_fill(spark, sf_dir):
    rows = invocations(spark, sf_dir).withColumn("name", F.when(F.col("task") == "signup", F.col("props")).otherwise(""))
    return ordered.carry_forward(rows, ["run_id"], [F.col("us"), F.col("invoc_id")], ["name"]).select("run_id", "invoc_id", "name")


@query(f"WITH {INV} SELECT run_id, count(*) FILTER (WHERE task = 'click') AS requested, count(*) FILTER (WHERE task = 'signup') AS allocated, count(*) FILTER (WHERE task = 'view' AND real_time < 50) AS completed, count(*) FILTER (WHERE task = 'view' AND real_time >= 5 AND real_time < 50) AS failed, count(*) FILTER (WHERE task = 'view' AND real_time >= 50) AS killed FROM inv GROUP BY run_id")
def container_counters(spark, sf_dir):
    kinds = {"click": "container-requested", "signup": "container-allocated", "view": "container-completed"}
    kind = F.coalesce(*(F.when(F.col("task") == k, F.lit(v)) for k, v in kinds.items()))
    rows = invocations(spark, sf_dir).withColumn("kind", kind).withColumn("code", F.when(F.col("real_time") < 5, 0).when(F.col("real_time") < 50, 1).otherwise(-100))
    return provenance.counters(rows, ["run_id"], "kind", "code")


@query("SELECT o_orderpriority AS wf_name, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS progress FROM orders GROUP BY o_orderpriority")
def workflow_progress(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("wf_name")).agg(F.count("*").alias("total"), done.alias("completed"))
    return rows.withColumn("progress", F.round(scalar.progress(F.col("completed").cast("double"), F.col("total")), 6))


# graphs


def _completed(nodes: DataFrame) -> DataFrame:
    return nodes.filter("cost < 40 and id < 64").select("run", "id")


@query(f"WITH RECURSIVE {GRAPH}, paths(id, d) AS (SELECT 1, 0 UNION SELECT e.b, d + 1 FROM paths JOIN edges e ON e.a = paths.id) SELECT id, max(d) AS depth FROM paths GROUP BY id")
def dag_depth(spark, sf_dir):
    nodes, edges = task_graph(spark, sf_dir)
    return graph.depths(nodes, edges, ["run"]).select("id", "depth")


@query(f"WITH RECURSIVE {GRAPH}, paths(id, r) AS (SELECT id, cost FROM nodes WHERE id NOT IN (SELECT a FROM edges) UNION SELECT e.a, r + n.cost FROM paths JOIN edges e ON e.b = paths.id JOIN nodes n ON n.id = e.a) SELECT id, max(r) AS upward_rank FROM paths GROUP BY id")
def dag_upward_rank(spark, sf_dir):
    nodes, edges = task_graph(spark, sf_dir)
    return graph.upward_ranks(nodes, edges, ["run"]).select("id", "upward_rank")


@query(f"WITH {GRAPH} SELECT id, id NOT IN (SELECT b FROM edges) AS is_root, id NOT IN (SELECT a FROM edges) AS is_leaf FROM nodes")
def dag_roots_leaves(spark, sf_dir):
    nodes, edges = task_graph(spark, sf_dir)
    return graph.roots_and_leaves(nodes, edges, ["run"]).select("id", "is_root", "is_leaf")


@query(f"WITH {GRAPH}, done AS (SELECT id FROM nodes WHERE cost < 40 AND id < 64) SELECT id FROM nodes n WHERE id NOT IN (SELECT id FROM done) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.b = n.id AND e.a NOT IN (SELECT id FROM done))")
def ready_tasks(spark, sf_dir):
    nodes, edges = task_graph(spark, sf_dir)
    return graph.ready(nodes, edges, _completed(nodes), ["run"]).select("id")


@query("WITH o AS (SELECT l_suppkey AS run, l_partkey AS file, max(l_orderkey) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT DISTINCT o.run, o.a, l.l_orderkey AS b FROM o JOIN lineitem l ON l.l_suppkey = o.run AND l.l_partkey = o.file WHERE l.l_returnflag <> 'R' AND o.a <> l.l_orderkey")
def producer_consumer_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("id"), "l_returnflag")
    return graph.producer_consumer_edges(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'"), ["run"], ["id"])


# placement


@query("WITH h AS (SELECT s_suppkey AS host, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier), t AS (SELECT p_brand AS run, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS k FROM part) SELECT run, id, host FROM t JOIN h ON t.k % h.n = h.k")
def round_robin_assign(spark, sf_dir):
    tasks = read(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id"), F.col("p_size").alias("depth"))
    hosts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"))
    return schedule.round_robin(tasks, hosts, ["run"], ["depth", "id"], "host").select("run", "id", "host")


@query("SELECT p_brand AS run, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part")
def fifo_queue(spark, sf_dir):
    return schedule.queue_order(read(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id")), ["run"], ["id"])


@query("WITH c AS (SELECT p_type AS name, max(p_size) * 100 AS mb FROM part WHERE p_size < 48 AND p_type < 'M' GROUP BY p_type), t AS (SELECT p_brand AS run, p_partkey AS id, CAST(ceil(coalesce(mb, 1024) / 1024) * 1024 AS BIGINT) AS memory_mb FROM part LEFT JOIN c ON p_type = name) SELECT *, row_number() OVER (PARTITION BY run, memory_mb ORDER BY id) AS position FROM t")
def fifo_by_memory(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    custom = part.filter("p_size < 48 and p_type < 'M'").groupBy(F.col("p_type").alias("name")).agg((F.max("p_size") * 100).alias("mb"))
    tasks = part.select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return schedule.by_memory(tasks, custom, ["run"], ["id"], 1024, 1024).select("run", "id", "memory_mb", "position")


@query("WITH t AS (SELECT p_type AS name, p_partkey % 7 AS tries FROM part) SELECT name, count(*) FILTER (WHERE tries <= 1) AS retried, count(*) FILTER (WHERE tries > 1) AS given_up FROM t GROUP BY name")
def retries(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_type").alias("name"), (F.col("p_partkey") % 7).alias("tries"))
    return rows.groupBy("name").agg(F.count_if(scalar.retried(F.col("tries"))).alias("retried"), F.count_if(~scalar.retried(F.col("tries"))).alias("given_up"))


def _runs(spark, sf_dir):
    """Graphs of one run per brand: nodes (run, id, name, cost) and edges."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    part = read(spark, sf_dir, "part").withColumn("k", F.row_number().over(w))
    nodes = part.select(F.col("p_brand").alias("run"), F.col("k").alias("id"), F.col("p_type").alias("name"), F.col("p_size").cast("double").alias("cost"))
    up = nodes.filter("id > 1").select("run", F.explode(F.array_distinct(F.array(F.expr("cast(id div 2 as int)"), F.expr("cast(id div 3 as int)")))).alias("a"), F.col("id").alias("b"))
    return nodes, up.filter("a >= 1")


def _costs(spark, sf_dir):
    """Mean quantity of each kind of task on each supplier's nation: a small table."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name")), "l_partkey")
    li = li.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("host")), "l_suppkey")
    return li.groupBy("name", "host").agg(F.avg("l_quantity").alias("estimate"))


@query()
def heft_schedule(spark, sf_dir):
    nodes, edges = _runs(spark, sf_dir)
    costs = _costs(spark, sf_dir)
    mean = costs.groupBy("name").agg(F.avg("estimate").alias("mean"))
    costed = nodes.join(mean, "name", "left").select("run", "id", "name", F.coalesce("mean", F.lit(0.0)).alias("cost"))
    ranked = graph.upward_ranks(costed, edges, ["run"]).join(graph.depths(nodes, edges, ["run"]), ["run", "id"]).join(nodes.select("run", "id", "name"), ["run", "id"])
    return schedule.heft(ranked, edges, costs, "run", slots=2)


@query()
def era_replay(spark, sf_dir):
    """Each day's invocations in turn: who asks is its host, what is ready are that day's tasks by kind. Estimates are
    those of the days before, when the first host asks: the 20 % quantile for what is ready, the last value for copies."""
    rows = invocations(spark, sf_dir).select("run_id", "invoc_id", "task", "host", "us", "ms", "real_time")
    known = _days_before(rows)
    known, rows = (x.toDF(*x.columns) for x in (known, rows))  # columns of their own

    def decide(day, before):
        import pandas as pd

        if not len(day):
            return pd.DataFrame({c: [] for c in ("run_id", "ask", "host", "task", "invoc_id", "is_replica")})
        day = day.sort_values(["us", "invoc_id"])
        now = float(day["ms"].iloc[0])
        state = {(t, h): s for t, h, *s in before[["task", "host", "n", "total", "squares", "last", "at", "seen"]].itertuples(index=False)} if len(before) else {}

        def guess(kind, host, copy):
            s = state.get((kind, host))
            return 0.0 if s is None else live.quantile(tuple(s), now, 0.5 if copy else 0.2)

        got = schedule.era_replay(list(zip(day["task"], day["invoc_id"].tolist())), day["host"].tolist(), guess, 1)
        return pd.DataFrame([(day["run_id"].iloc[0], *g) for g in got], columns=["run_id", "ask", "host", "task", "invoc_id", "is_replica"])

    return rows.groupBy("run_id").cogroup(known.groupBy("run_id")).applyInPandas(decide, "run_id string, ask int, host long, task string, invoc_id long, is_replica boolean")


def _days_before(rows: DataFrame) -> DataFrame:
    """(run_id, task, host, n, total, squares, last, at, seen): for each day what was measured up to the day before."""
    w = Window.partitionBy("task", "host").orderBy("us", "invoc_id")
    dt = F.col("ms") - F.lag("ms").over(w)
    steps = rows.withColumn("step", F.when(dt > 0, (F.col("real_time") - F.lag("real_time").over(w)) / F.sqrt(F.when(dt > 0, dt))))
    place = F.struct("us", "invoc_id")
    days = steps.groupBy("task", "host", F.to_date("run_id").alias("day")).agg(
        F.count("step").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("step") ** 2), F.lit(0.0)).alias("squares"),
        F.max_by("real_time", place).alias("last"), F.max_by("ms", place).alias("at"), F.count("*").alias("seen"),
    )
    upto = Window.partitionBy("task", "host").orderBy("day")
    sums = [F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in ("n", "total", "squares", "seen")]
    days = days.select("task", "host", "day", *sums, "last", "at", F.lead("day").over(upto).alias("until"))
    end = rows.agg(F.max(F.to_date("run_id"))).first()[0]
    later = days.filter(F.col("day") < F.lit(end)).withColumn("run_id", F.explode(F.sequence(F.date_add("day", 1), F.coalesce("until", F.lit(end)))))
    return later.select(F.col("run_id").cast("string").alias("run_id"), "task", "host", "n", "total", "squares", "last", "at", "seen")


# scalars and shapes


@query("WITH h AS (SELECT p_partkey, p_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) + 1 AS h FROM part) SELECT p_partkey, p_name, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT) AS task_id FROM h")
def java_task_id(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", scalar.java_task_id(F.col("p_name")).alias("task_id"))


@query("SELECT o_orderkey, k AS copy, substr('run-' || CAST(o_orderkey AS VARCHAR), 1, 36) || '_' || CAST(1700000000000 + k AS VARCHAR) AS run_id FROM orders, range(3) t(k)")
def amplified_runs(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"))
    return logs.amplified(runs, 3, 1_700_000_000_000).select("o_orderkey", F.col("copy").cast("long").alias("copy"), "run_id")


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS renamed, split_part(p_name, ' ', 1) AS base, upper(p_brand) AS brand, CAST(ceil(p_size / 8.0) * 8 AS BIGINT) AS rounded FROM part")
def scalar_text(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    dotted = F.concat(F.lit("/data/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    return p.select("p_partkey", scalar.underscored(F.col("p_name")).alias("renamed"), scalar.base_name(dotted).alias("base"), F.upper("p_brand").alias("brand"), scalar.round_up(F.col("p_size"), F.lit(8.0)).alias("rounded"))


@query("SELECT c_custkey, 'c_mktsegment' AS name, c_mktsegment AS value FROM customer")
def env_pairs(spark, sf_dir):
    pair = scalar.env_pair(F.concat(F.lit("c_mktsegment="), F.col("c_mktsegment")))
    return read(spark, sf_dir, "customer").select("c_custkey", pair["name"].alias("name"), pair["value"].alias("value"))


@query("SELECT l_partkey AS file FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def answer_known_files(spark, sf_dir):
    known = read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("file"))
    return read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("file")).distinct().join(known, "file", "left_semi")


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, 'order' AS kind FROM orders UNION ALL SELECT event_id, 'event' FROM events")
def union_logs(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")).unionByName(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind")))


from . import log_queries, source_queries  # noqa: E402, F401  they register theirs
