"""Queries over text that the given tables are written as first: logs, workflow descriptions, small formats, streams.

Each writes its files to the shared folder, reads them back with the library's readers, and says in SQL over the tables
what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import schema as S
from ..operators import estimate, graph, schedule
from ..sources import dax, galaxy, logs
from ..storage import scratch
from ..streaming import live
from . import plugins
from .queries import HOUR, INV, SQL, _costs, _runs, era_replay, query, six
from .tables import invocations, read


def _written(df: DataFrame, *by: str) -> str:
    """Text (value) in a new folder, one of its own for each value of by."""
    path = scratch(df.sparkSession)
    writer = df.write
    (writer.partitionBy(*by) if by else writer).text(path)
    return path


def _from(path: str) -> Column:
    """The number in a path's folder name, after the equals sign."""
    return F.regexp_extract(path, r"=(\d+)/", 1).cast("long")


# logs


def _customers(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") * 10).cast("long").alias("timestamp"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("run_id"), F.lit(7).cast("long").alias("task_id"),
        F.col("c_name").alias("task_name"), F.lit("bash").alias("lang"), F.col("c_custkey").cast("long").alias("invoc_id"), F.lit(None).cast("string").alias("file"),
        F.lit(S.TIME).alias("key"), F.concat(F.lit('{"realTime":"'), F.col("c_custkey").cast("string"), F.lit('"}')).alias("value"),
    )


CUSTOMER = "c_custkey * 10 AS \"timestamp\", 'r' || c_nationkey AS run_id, c_name AS task_name, c_custkey AS invoc_id, 'invoc-time' AS key, '{\"realTime\":\"' || c_custkey || '\"}' AS value"
KEPT = ["timestamp", "run_id", "task_name", "invoc_id", "key", "value"]


@query(f"SELECT {CUSTOMER} FROM customer")
def log_files(spark, sf_dir):
    """A folder of logs, one for each run, with blank lines and blanks around entries."""
    lines = logs.as_lines(_customers(spark, sf_dir)).withColumn("run", F.get_json_object("value", "$.run_id"))
    path = _written(lines.select("run", F.concat(F.lit("\n  "), "value", F.lit("  \n\n")).alias("value")), "run")
    return logs.read_log(spark, path + "/*/*.txt").select(*KEPT)


@query(f"SELECT {CUSTOMER} FROM customer")
def log_appended(spark, sf_dir):
    """A log that was written in two goes."""
    path, rows = scratch(spark), _customers(spark, sf_dir)
    logs.append_log(rows.filter("invoc_id % 2 = 0"), path)
    logs.append_log(rows.filter("invoc_id % 2 = 1"), path)
    return logs.read_log(spark, path + "/*.txt").select(*KEPT)


@query(f"SELECT {CUSTOMER} FROM customer")
def task_reports(spark, sf_dir):
    """Reports in which each entry stands twice."""
    rows = _customers(spark, sf_dir)
    return logs.read_report(spark, _written(logs.as_lines(rows.unionAll(rows))) + "/*.txt").select(*KEPT)


@query("SELECT c_custkey * 10 AS \"timestamp\", row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def log_normalised(spark, sf_dir):
    """Entries written in the order of time: in one file, their line numbers are their places."""
    path, rows = scratch(spark), _customers(spark, sf_dir).withColumn("source", F.lit("s")).withColumn("line_no", -F.col("invoc_id"))
    logs.write_normalised(rows, path)
    lines = logs.read_log(spark, path + "/*.txt")
    return lines.select("timestamp", F.row_number().over(Window.orderBy("source", "line_no")).cast("long").alias("place"))


@query(f"SELECT {CUSTOMER} FROM customer")
def live_log(spark, sf_dir):
    """The same entries as a stream of files, appended to a table once each."""
    path = _written(logs.as_lines(_customers(spark, sf_dir)).unionAll(spark.createDataFrame([("",), ("  ",)], "value string")))
    table, checkpoint = scratch(spark), scratch(spark)
    live.append_to(live.read_live(spark, path), table, checkpoint, "now").start().awaitTermination()
    return spark.read.parquet(table).select(*KEPT)


def _measured(spark, sf_dir) -> tuple[DataFrame, str]:
    """The last estimates of a stream of measurements that comes in four files, oldest first; and the decisions after
    each refresh, as a folder."""
    rows = invocations(spark, sf_dir).select(F.col("host").cast("string").alias("host"), "task", "ms", "real_time", "us", "invoc_id")
    bounds = rows.approxQuantile("us", [0.25, 0.5, 0.75], 0.0)
    path = scratch(spark)
    parts = [None, *bounds, None]
    for a, b in zip(parts, parts[1:]):
        part = rows if a is None else rows.filter(F.col("us") > a)
        part = part if b is None else part.filter(F.col("us") <= b)
        part.select("host", "task", "ms", "real_time").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("host string, task string, ms double, real_time double").option("maxFilesPerTrigger", 1).parquet(path)
    changes, picks = scratch(spark), scratch(spark)

    def decide(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{changes}/n={batch}")
        known = spark.read.parquet(changes).groupBy("host", "task").agg(F.max_by("estimate", "batch").alias("estimate"))
        matrix = estimate.full_matrix(known, known, known, "task", "host")
        estimate.sufferage_picks(estimate.sufferage(matrix, "task", "host"), "task", "host").withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{picks}/n={batch}")

    live.refreshed(live.live_estimates(stream, 0.2, HOUR), decide, scratch(spark), "now").start().awaitTermination()
    return spark.read.parquet(changes).groupBy("host", "task").agg(F.max_by(F.struct("estimate", "measurements"), "batch").alias("e")).select("host", "task", "e.*"), picks


@query(SQL["wiener_estimate_q20"].replace("SELECT task, host,", "SELECT task, CAST(host AS VARCHAR) AS host,"))
def live_estimates(spark, sf_dir):
    """After the last batch the stream's estimates are those of all measurements at once."""
    return _measured(spark, sf_dir)[0].select("task", "host", *six("estimate"))


@query("SELECT event_type AS task, CAST(user_id AS VARCHAR) AS host, count(*) AS measurements FROM events GROUP BY ALL")
def live_measurements(spark, sf_dir):
    return _measured(spark, sf_dir)[0].select("task", "host", "measurements")


@query(
    "WITH e AS (SELECT event_type AS task, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) / 1000.0 AS ms, event_id % 2 AS batch FROM events), m AS (SELECT host, max(ms) AS mark FROM e WHERE batch = 0 GROUP BY host) "
    "SELECT task, e.host, count(*) AS measurements FROM e LEFT JOIN m ON e.host = m.host WHERE batch = 0 OR mark IS NULL OR ms > mark GROUP BY task, e.host"
)
def late_measurements_are_missed(spark, sf_dir):
    """What comes in a later batch but is older than its host's mark is dropped for good, also for tasks that are new."""
    rows = invocations(spark, sf_dir).select(F.col("host").cast("string").alias("host"), "task", "ms", "real_time", "invoc_id")
    path, changes = scratch(spark), scratch(spark)
    for batch in (0, 1):
        rows.filter(F.col("invoc_id") % 2 == batch).select("host", "task", "ms", "real_time").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("host string, task string, ms double, real_time double").option("maxFilesPerTrigger", 1).parquet(path)
    keep = lambda changed, batch: changed.write.mode("overwrite").parquet(f"{changes}/n={batch}")
    live.refreshed(live.live_estimates(stream, 0.2, HOUR), keep, scratch(spark), "now").start().awaitTermination()
    return spark.read.parquet(changes).groupBy("host", "task").agg(F.max("measurements").alias("measurements"))


@query("SELECT DISTINCT p_brand AS run, p_partkey AS id FROM part")
def nodes_as_they_arrive(spark, sf_dir):
    """Nodes of graphs that aren't known beforehand, some of which arrive twice."""
    path, table = scratch(spark), scratch(spark)
    nodes = read(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id"))
    nodes.unionAll(nodes.filter("id % 2 = 0")).write.parquet(path)
    stream = plugins.new_nodes(spark.readStream.schema(nodes.schema).parquet(path))
    live.append_to(stream, table, scratch(spark), "now").start().awaitTermination()
    return spark.read.parquet(table)


# small formats


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def ini_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.concat(F.lit("# a comment\n[part]\n "), "n_name", F.lit(" = "), F.col("n_nationkey").cast("string")).alias("value"))
    return logs.read_ini(spark, _written(rows))


@query("SELECT p_type AS name, max(p_size) * 100 AS mb FROM part GROUP BY p_type")
def memory_by_task(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").groupBy("p_type").agg((F.max("p_size") * 100).alias("mb"))
    whole = sizes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "mb")))).alias("value"))
    return logs.read_memory(spark, _written(whole) + "/*.txt")


@query("SELECT s_suppkey, s_name FROM supplier")
def reference_table(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("#no row\n"), F.col("s_suppkey").cast("string"), F.lit("\t"), "s_name", F.lit("\tmore")).alias("value"))
    got = logs.read_data_table(spark, _written(rows), ["s_suppkey", "s_name"], "#")
    return got.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("SELECT n_nationkey, n_name FROM nation")
def tsv_report(spark, sf_dir):
    path = scratch(spark)
    logs.write_tsv(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="n_nationkey int, n_name string")


@query("SELECT '{\"output\":[' || string_agg('\"' || r_name || '\"', ',' ORDER BY r_name) || '],\"stdout\":\"out\",\"stderr\":\"err\",\"statlog\":\"log\"}' AS value FROM region")
def run_summary(spark, sf_dir):
    return logs.summary(read(spark, sf_dir, "region").select(F.col("r_name").alias("file")), "out", "err", "log")


FILES = "SELECT l_orderkey AS task, 'f' || l_linenumber || '_' || l_partkey AS path, CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'c' || l_suppkey END AS container, l_returnflag = 'R' AS is_output FROM lineitem"


@query(f"SELECT DISTINCT task, path, coalesce(container, '') AS container, is_output FROM ({FILES})")
def staging_manifests(spark, sf_dir):
    """Manifests of tasks' files, written and read."""
    li = read(spark, sf_dir, "lineitem")
    output = F.col("l_returnflag") == "R"
    files = li.select(
        F.col("l_orderkey").alias("task"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("path"),
        F.when((F.col("l_linestatus") == "F") & ~output, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).alias("container"), output.alias("is_output"),
    )
    # as lines of one text per task, numbered as a file's would be
    lines = logs.manifests(files.distinct()).select(F.col("task").cast("string").alias("source"), F.posexplode(F.split("value", "\n")).alias("at", "line")).select("source", "line", (F.col("at") + 1).alias("line_no"))
    return logs.manifest_rows(lines).select(F.col("source").cast("long").alias("task"), "path", F.coalesce("container", F.lit("")).alias("container"), "is_output")


@query("SELECT l_orderkey AS invoc_id, 'p' || l_partkey AS file, CASE WHEN l_returnflag = 'R' THEN k || 'out' ELSE k || 'in' END AS key, CASE k WHEN 'file-time-stage' THEN '{\"realTime\":\"' || CAST(floor(l_quantity) AS BIGINT) || '\"}' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS value FROM lineitem, (SELECT unnest(['file-time-stage', 'file-size-stage']) AS k)")
def staging_entries(spark, sf_dir):
    """Entries of files that were moved in and out."""
    li = read(spark, sf_dir, "lineitem")
    moved = li.select(
        F.lit("r").alias("run_id"), F.lit(1).cast("long").alias("task_id"), F.lit("t").alias("task_name"), F.lit("bash").alias("lang"), F.col("l_orderkey").alias("invoc_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"), (F.col("l_returnflag") == "R").alias("is_output"), F.lit(1000).cast("long").alias("begin"),
        (F.lit(1000) + F.floor("l_quantity")).alias("end"), F.floor("l_extendedprice").alias("size"),
    )
    return logs.staged(moved).select("invoc_id", "file", "key", "value")


@query("SELECT s_suppkey, '/c/c' || s_nationkey || '/f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN '/base' ELSE '/app' END || '/f' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def resolved_paths(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    file = F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))
    files = s.select("s_suppkey", file.alias("file"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("c"), F.col("s_nationkey").cast("string"))).alias("container"))
    present = s.filter("s_suppkey % 3 = 1").select(F.concat(F.lit("/base/"), file).alias("path"))
    return logs.resolved(files, "/c", "/base", "/app", present).select("s_suppkey", "path")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'dax' WHEN 1 THEN 'dax' WHEN 2 THEN 'galaxy' WHEN 3 THEN 'log' ELSE 'none' END AS lang FROM part")
def languages_by_ending(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, ["a.xml", "b/c.DAX", "d.e.ga", "f.log", "axml"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(logs.language(endings), F.lit("none")).alias("lang"))


# abstract workflows in XML: a run for each brand, its parts as jobs; job k's parents are k div 2 and k div 3

JOBS = "jobs AS (SELECT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_type AS name, p_size AS size FROM part), up AS (SELECT DISTINCT run, a, k AS b FROM (SELECT run, k // 2 AS a, k FROM jobs WHERE k > 1 UNION ALL SELECT run, k // 3, k FROM jobs WHERE k > 1) WHERE a >= 1)"


def _jobs(spark, sf_dir) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    return read(spark, sf_dir, "part").select(F.substring_index("p_brand", "#", -1).cast("long").alias("run"), k.alias("k"), F.col("p_type").alias("name"), F.col("p_size").alias("size"))


def _parents(k: Column) -> Column:
    return F.filter(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3))), lambda a: a >= 1)


def _dax(spark, sf_dir):
    k, text = F.col("k"), lambda c: c.cast("string")
    uses = F.array_join(F.transform(_parents(k), lambda a: F.concat(F.lit('<uses file="f'), text(a), F.lit('" link="input" size="1"/>'))), "")
    job = F.concat(
        F.lit('<job id="j'), text(k), F.lit('" name="'), "name", F.lit('"'), F.when(F.col("size") < 5, F.lit(' runtime="3"')).otherwise(""), F.lit("><argument> -a \t <file name=\"in"), text(k), F.lit('"/>  b  <filename file="x"/></argument>'),
        F.lit('<uses file="exe" link="input" type="executable"/>'), uses, F.lit('<uses file="f'), text(k), F.lit('" link="output" size="'), text(F.col("size")), F.lit('"/><uses file="tmp'), text(k), F.lit('" link="input"/><uses file="tmp'), text(k), F.lit('" link="output"/></job>'),
    )
    child = F.concat(F.lit('<child ref="j'), text(k), F.lit('">'), F.array_join(F.transform(_parents(k), lambda a: F.concat(F.lit('<parent ref="j'), text(a), F.lit('"/>'))), ""), F.lit("</child>"))
    each = _jobs(spark, sf_dir).select("run", "k", job.alias("job"), F.when(k > 1, child).otherwise("").alias("child"))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), "")
    whole = each.groupBy("run").agg(F.concat(F.lit("<adag>"), listed("job"), listed("child"), F.lit("</adag>")).alias("value"))
    plugins.register_language("txt", dax.read)  # by the ending of the files that Spark writes
    return plugins.read_workflow(spark, _written(whole, "run") + "/*/*.txt")


def _job(c: str) -> Column:
    return F.substring(c, 2, 20).cast("long")


@query(f"WITH {JOBS} SELECT run, k AS id, name, CASE WHEN size < 5 THEN 'sleep 3.0 dd if=/dev/zero of=f' || k || ' bs=' || size || ' count=1' ELSE name || ' -a in' || k || ' b x' END AS command FROM jobs")
def dax_nodes(spark, sf_dir):
    nodes = _dax(spark, sf_dir)[0]
    return nodes.select(_from("run").alias("run"), _job("id").alias("id"), "name", F.replace(F.col("command"), F.lit("\n"), F.lit(" ")).alias("command"))


@query(f"WITH {JOBS} SELECT run, a, b FROM up")
def dax_edges(spark, sf_dir):
    return _dax(spark, sf_dir)[1].select(_from("run").alias("run"), _job("a").alias("a"), _job("b").alias("b"))


@query(f"WITH {JOBS} SELECT run, k AS id, 'f' || k AS file, 'output' AS direction, CAST(size AS BIGINT) AS size, NOT EXISTS (SELECT 1 FROM up WHERE up.run = jobs.run AND a = k) AS is_output FROM jobs UNION ALL SELECT run, b, 'f' || a, 'input', 1, false FROM up UNION ALL SELECT run, k, 'tmp' || k, 'input', 0, false FROM jobs")
def dax_files(spark, sf_dir):
    """Executables don't count, nor outputs that are inputs of the same job; outputs of leaves are the workflow's."""
    io = _dax(spark, sf_dir)[2]
    return io.select(_from("run").alias("run"), _job("id").alias("id"), "file", "direction", "size", "is_output")


@query(f"WITH {JOBS} SELECT b.run, b AS id, 'f' || a AS file FROM up b UNION ALL SELECT run, k, 'tmp' || k FROM jobs WHERE size >= 5")
def dax_needed_inputs(spark, sf_dir):
    """Of synthetic jobs' inputs only those that others produce."""
    nodes, _, io = _dax(spark, sf_dir)
    return dax.needed_inputs(nodes, io).select(_from("run").alias("run"), _job("id").alias("id"), "file")


@query(f"WITH {JOBS} SELECT run, k AS id, 'f' || k AS file FROM jobs WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.run = jobs.run AND a = k)")
def workflow_outputs(spark, sf_dir):
    return _dax(spark, sf_dir)[2].filter("is_output").select(_from("run").alias("run"), _job("id").alias("id"), "file")


# tool workflows: a run for each brand; step 0 gives a file, step k reads the output of step k div 2


def _tool_steps(spark, sf_dir) -> DataFrame:
    k, text = F.col("k"), lambda c: c.cast("string")
    up = F.floor(k / 2)
    source = F.when(up == 0, F.lit("output")).otherwise("out")
    state = F.lit('"{\\"a\\": \\"null\\", \\"c\\": {\\"__class__\\": \\"UnvalidatedValue\\", \\"value\\": 5}}"')
    renamed = F.when(k % 4 == 1, F.concat(F.lit('{"r":{"action_type":"RenameDatasetAction","output_name":"out","action_arguments":{"newname":"new name '), text(k), F.lit('"}}}'))).when(k % 4 == 2, F.lit('{"h":{"action_type":"HideDatasetAction","output_name":"out","action_arguments":{}}}')).otherwise("{}")
    step = F.concat(
        F.lit('"'), text(k), F.lit('":{"id":'), text(k), F.lit(',"type":"tool","inputs":[],"tool_id":"host/repos/own/tool'), text(k % 4), F.lit('/1.0","tool_version":"1.0","tool_state":'), state,
        F.lit(',"input_connections":{"in":{"id":'), text(up), F.lit(',"output_name":"'), source, F.lit('"}},"outputs":[{"name":"out"}],"post_job_actions":'), renamed, F.lit("}"),
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "step"))), lambda x: x["step"]), ",")
    first = '{"steps":{"0":{"id":0,"type":"data_input","inputs":[{"name":"data.v1.txt"}],"tool_id":null,"tool_state":"{}","input_connections":{},"outputs":[],"post_job_actions":{}},'
    whole = _jobs(spark, sf_dir).withColumn("step", step).groupBy("run").agg(F.concat(F.lit(first), listed, F.lit("}}")).alias("value"))
    return galaxy.read_steps(spark, _written(whole, "run") + "/*/*.txt")


#: Three tools (the fourth isn't known): a declared type, the input's type, and a macro in the command.
TOOLS = [
    '<tool id="tool0" version="1.0"><command interpreter="python">run.py $in.value $out</command><inputs><param name="ref"><options from_data_table="genomes"/></param></inputs><outputs><data name="out" format="bam"/></outputs></tool>',
    '<tool id="tool1" version="1.0"><macros><xml name="m">A<yield/>B</xml></macros><requirements><requirement version="2">sam</requirement></requirements><command>x ${out} <expand macro="m"> y </expand></command><outputs><data name="out" format="input"/></outputs></tool>',
    '<tool id="tool2" version="1.0"><command>z $in.dataset</command><outputs><data name="out" format="bam"/></outputs></tool>',
]


def _tools(spark) -> DataFrame:
    return galaxy.read_tools(spark, _written(spark.createDataFrame(list(enumerate(TOOLS)), "n int, value string"), "n") + "/*/*.txt")


def _tool_workflow(spark, sf_dir):
    types = '<registry><datatype extension="bam" type="binary:Bam"/><datatype extension="v1.txt" type="data:Text"/><datatype extension="sub" type="a:B" subclass="True"/></registry>'
    kinds = galaxy.read_data_types(spark, _written(spark.createDataFrame([(types,)], "value string")))
    return galaxy.workflow(_tool_steps(spark, sf_dir), _tools(spark), kinds)


@query(f"WITH {JOBS} SELECT run, k AS id, 'tool' || (k % 4) AS name FROM jobs WHERE k % 4 < 3")
def tool_nodes(spark, sf_dir):
    return _tool_workflow(spark, sf_dir)[0].select(_from("run").alias("run"), "id", "name")


@query(f"WITH {JOBS} SELECT run, k // 2 AS a, k AS b FROM jobs WHERE k > 1")
def tool_edges(spark, sf_dir):
    return _tool_workflow(spark, sf_dir)[1].select(_from("run").alias("run"), "a", "b")


@query(f"WITH {JOBS} SELECT run, k AS id, 'tool' || (k % 4) AS tool_id FROM jobs WHERE k % 4 = 3")
def tools_missing(spark, sf_dir):
    return _tool_workflow(spark, sf_dir)[3].select(_from("run").alias("run"), "id", "tool_id")


@query(
    f"WITH {JOBS}, t AS (SELECT run, k, CASE k % 4 WHEN 0 THEN '.bam' WHEN 2 THEN '.bam' WHEN 1 THEN CASE WHEN k = 1 THEN '.v1.txt' WHEN k // 2 % 4 IN (0, 2) THEN '.bam' ELSE '' END END AS kind FROM jobs WHERE k % 4 < 3) "
    "SELECT run, k AS id, CASE WHEN k % 4 = 1 THEN 'new_name_' || k ELSE k || '_out' || kind END AS file, k % 4 <> 2 AS is_output FROM t"
)
def tool_outputs(spark, sf_dir):
    """Outputs with their types, new names, and whether they are hidden."""
    io = _tool_workflow(spark, sf_dir)[2]
    return io.filter("direction = 'output'").select(_from("run").alias("run"), "id", "file", "is_output")


@query(f"WITH {JOBS} SELECT run, k AS id, CASE WHEN k < 2 THEN 'data.v1.txt' WHEN k // 2 % 4 = 1 THEN 'new_name_' || (k // 2) ELSE k // 2 || '_out.bam' END AS file FROM jobs WHERE k < 2 OR k // 2 % 4 < 3")
def tool_inputs(spark, sf_dir):
    io = _tool_workflow(spark, sf_dir)[2]
    return io.filter("direction = 'input'").select(_from("run").alias("run"), "id", "file")


@query(f"WITH {JOBS} SELECT run, k AS id, 'tool' || (k % 4) AS tool_id, '' AS a, '5' AS c FROM jobs")
def tool_states(spark, sf_dir):
    """Tool state after its repair, as JSON."""
    steps = _tool_steps(spark, sf_dir).filter("type = 'tool'")
    return steps.select(_from("run").alias("run"), "id", "tool_id", *(F.get_json_object("tool_state", f"$.{c}").alias(c) for c in "ac"))


@query(f"WITH {JOBS} SELECT run, k AS id, '{{\"a\":\"none\",\"c\":5}}' AS state FROM jobs")
def tool_states_mapped(spark, sf_dir):
    """Tool state with its atoms looked up."""
    steps = _tool_steps(spark, sf_dir).filter("type = 'tool'")
    return steps.select(_from("run").alias("run"), "id", plugins.mapped_state(F.col("tool_state"), {"": "none"}).alias("state"))


@query("SELECT 'tool0' AS tool_id, 'python ' || '{}/run.py $in $out.path' AS template UNION ALL SELECT 'tool1', 'x ${out.path} AyB' UNION ALL SELECT 'tool2', 'z $in'")
def tool_templates(spark, sf_dir):
    """Commands with their macros expanded, paths of outputs, and without suffixes."""
    return _tools(spark).select("tool_id", F.regexp_replace("template", r"python \S*/run", "python {}/run").alias("template"))


@query("SELECT 'tool0' AS tool_id, 'ref' AS param, n_name AS value, CAST(n_nationkey AS VARCHAR) AS content FROM nation")
def tool_table_parameters(spark, sf_dir):
    """Parameters that take their values from a reference table, which a configuration names."""
    rows = read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("\t"), F.col("n_nationkey").cast("string")).alias("value"))
    config = f'<tables><table name="genomes" comment_char=""><columns>value, content</columns><file path="{_written(rows)}"/></table></tables>'
    (t,) = galaxy.read_table_config(spark, _written(spark.createDataFrame([(config,)], "value string"))).collect()
    values = logs.read_data_table(spark, t.file, t["columns"], t.comment).withColumn("table", F.lit(t.table))
    return plugins.table_parameters(_tools(spark), values)


@query("SELECT 'tool1' AS tool_id, r_regionkey + 1 AS n, 'export R=' || r_name AS line FROM region")
def tool_environments(spark, sf_dir):
    """Lines of the env.sh of a tool's requirement, by its repository."""
    config = '<toolbox tool_path="lib"><section><tool file="one.xml"><repository_name>rep</repository_name><repository_owner>own</repository_owner><installed_changeset_revision>abc</installed_changeset_revision></tool><tool file="two.xml"/></section></toolbox>'
    listed = galaxy.read_tool_list(spark, _written(spark.createDataFrame([(config,)], "value string")) + "/*.txt")
    tools = _tools(spark).withColumn("file", F.when(F.col("tool_id") == "tool1", "one.xml").otherwise("two.xml"))
    lines = read(spark, sf_dir, "region").select(F.lit("dep/sam/2/own/rep/abc/env.sh").alias("path"), (F.col("r_regionkey") + 1).alias("line_no"), F.concat(F.lit("export R="), "r_name").alias("line"))
    return galaxy.environments(listed, tools, "dep", lines).select("tool_id", F.col("line_no").alias("n"), "line")


# counts and placement


@query("SELECT o_orderpriority AS run, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_orderstatus = 'O') AS running, count(*) FILTER (WHERE o_orderstatus = 'P') - 2 AS finished, CAST(0 AS BIGINT) AS waiting, count(*) - 2 AS total FROM orders GROUP BY o_orderpriority")
def task_totals(spark, sf_dir):
    """Ready, running, finished (without two of an earlier run) and all tasks."""
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "running").otherwise("finished")
    return plugins.totals(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), state.alias("state")), ["run"], 2)


@query("SELECT o_custkey AS run, count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 AS done FROM orders GROUP BY o_custkey")
def runs_done(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "running").otherwise("ready")
    return plugins.is_done(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), state.alias("state")), ["run"])


HERE = "f AS (SELECT l_orderkey AS task, l_partkey AS file, CAST(floor(l_quantity) AS BIGINT) AS size FROM lineitem), h AS (SELECT p_partkey AS file, p_size % 4 AS host FROM part WHERE p_size < 20)"


@query(f"WITH {HERE}, t AS (SELECT task, sum(size) AS n FROM f GROUP BY task), l AS (SELECT task, host, sum(size) AS n FROM f JOIN h USING (file) GROUP BY task, host) SELECT task, host, CAST(t.n AS BIGINT) AS total_bytes, CAST(l.n AS BIGINT) AS local_bytes FROM l JOIN t USING (task)")
def local_input_bytes(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("file"), F.floor("l_quantity").alias("size"))
    hosts = read(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 4).alias("host"))
    return plugins.input_bytes(files, hosts, ["task"]).select("task", "host", "total_bytes", "local_bytes")


@query("SELECT p_brand AS run, count(*) AS placed, CAST(0 AS BIGINT) AS before_parents, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS out_of_cost FROM part GROUP BY p_brand")
def heft_is_a_schedule(spark, sf_dir):
    """Earliest-finish placement: every task once, none before its parents end, none at once with another on its
    container, each as long as it costs there."""
    nodes, edges = _runs(spark, sf_dir)
    costs = _costs(spark, sf_dir)
    mean = costs.groupBy("name").agg(F.avg("estimate").alias("mean"))
    costed = nodes.join(mean, "name", "left").select("run", "id", "name", F.coalesce("mean", F.lit(0.0)).alias("cost"))
    ranked = graph.upward_ranks(costed, edges, ["run"]).join(graph.depths(nodes, edges, ["run"]), ["run", "id"]).join(nodes.select("run", "id", "name"), ["run", "id"])
    placed = plugins.policy("HEFT")(ranked, edges, costs, "run", slots=2)
    parent = placed.select("run", F.col("id").alias("a"), F.col("finish").alias("parent_finish"))
    early = placed.join(edges.withColumnRenamed("b", "id"), ["run", "id"]).join(parent, ["run", "a"]).filter(F.col("start") < F.col("parent_finish") - 1e-9).groupBy("run").agg(F.count("*").alias("before_parents"))
    own = Window.partitionBy("run", "host", "slot").orderBy("start", "finish")
    lapped = placed.withColumn("_next", F.lead("start").over(own)).filter(F.col("_next") < F.col("finish") - 1e-9).groupBy("run").agg(F.count("*").alias("overlapping"))
    known = placed.join(nodes.select("run", "id", "name"), ["run", "id"]).join(costs, ["name", "host"], "left")
    wrong = known.filter(F.abs(F.col("finish") - F.col("start") - F.coalesce("estimate", F.lit(0.0))) > 1e-6).groupBy("run").agg(F.count("*").alias("out_of_cost"))
    out = placed.groupBy("run").agg(F.countDistinct("id").alias("placed"))
    for other in (early, lapped, wrong):
        out = out.join(other, "run", "left")
    return out.fillna(0)


@query(
    "WITH RECURSIVE n AS (SELECT p_brand AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS id, CAST(p_size AS DOUBLE) AS cost FROM part), "
    "e AS (SELECT DISTINCT run, a, b FROM (SELECT run, id // 2 AS a, id AS b FROM n WHERE id > 1 UNION ALL SELECT run, id // 3, id FROM n WHERE id > 1) WHERE a >= 1), "
    "p(run, id, r) AS (SELECT run, id, cost FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run = n.run AND e.a = n.id) UNION SELECT e.run, e.a, r + n.cost FROM p JOIN e ON e.run = p.run AND e.b = p.id JOIN n ON n.run = e.run AND n.id = e.a), "
    "d(run, id, d) AS (SELECT run, id, 0 FROM n WHERE id = 1 UNION SELECT e.run, e.b, d + 1 FROM d JOIN e ON e.run = d.run AND e.a = d.id), "
    "x AS (SELECT run, id, max(r) AS r FROM p GROUP BY run, id), y AS (SELECT run, id, max(d) AS d FROM d GROUP BY run, id) "
    "SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY r DESC, d, id) AS place FROM x JOIN y USING (run, id)"
)
def rank_order(spark, sf_dir):
    """Tasks by falling upward rank, then depth, then id."""
    nodes, edges = _runs(spark, sf_dir)
    ranked = graph.upward_ranks(nodes, edges, ["run"]).join(graph.depths(nodes, edges, ["run"]), ["run", "id"])
    return schedule.queue_order(ranked.withColumn("_r", -F.col("upward_rank")), ["run"], ["_r", "depth", "id"]).select("run", "id", F.col("position").cast("long").alias("place"))


@query(f"WITH {INV} SELECT run_id, count(*) AS placed, count(DISTINCT invoc_id) AS tasks, CAST(0 AS BIGINT) AS replicas FROM inv GROUP BY run_id")
def era_places_all(spark, sf_dir):
    """As many hosts ask as there are tasks, so that each task is placed once and none is copied."""
    got = era_replay(spark, sf_dir)
    return got.groupBy("run_id").agg(F.count("*").alias("placed"), F.countDistinct("invoc_id").alias("tasks"), F.count_if("is_replica").alias("replicas"))


# text


@query("SELECT p_partkey, replace('a\\' || p_name, '\\', '\\\\') AS escaped, p_brand || '.x ' || p_type AS plain, 'tool' || p_size AS tool, 'tar.' || (p_size % 3) AS first, trim(p_name) AS words, CAST(len(string_split(p_name, 'o')) AS BIGINT) AS parts FROM part")
def text_repairs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey", scalar.escape_backslashes(F.concat(F.lit("a\\"), "p_name")).alias("escaped"), scalar.without_suffixes(F.concat("p_brand", F.lit(".value.x "), "p_type", F.lit(".dataset"))).alias("plain"),
        scalar.tool_name(F.concat(F.lit("h/r/tool"), size, F.lit("/1.0"))).alias("tool"), scalar.first_extension(F.concat(F.lit("/a.b/c.tar."), (F.col("p_size") % 3).cast("string"))).alias("first"),
        scalar.normalised(F.concat(F.lit(" \t"), F.replace(F.col("p_name"), F.lit(" "), F.lit(" \n ")), F.lit("  "))).alias("words"), F.size(scalar.split_list(F.replace(F.col("p_name"), F.lit("o"), F.lit(", ")))).cast("long").alias("parts"),
    )


@query("SELECT p_partkey, '$' || 'a' || (p_size % 10) || '.path ${' || 'a' || (p_size % 10) || '.path} $b' AS command FROM part")
def path_suffixes(spark, sf_dir):
    name = F.concat(F.lit("a"), (F.col("p_size") % 10).cast("string"))
    template = F.concat(F.lit("$"), name, F.lit(" ${"), name, F.lit("} $b"))
    return read(spark, sf_dir, "part").select("p_partkey", scalar.with_path_suffix(template, [f"a{i}" for i in range(10)]).alias("command"))


@query("SELECT event_id, strftime(ts, '%y/%m/%d %H:%M:%S') AS shown FROM events")
def console_dates_of_millis(spark, sf_dir):
    """In the session's zone, from milliseconds in that zone."""
    rows = read(spark, sf_dir, "events").withColumn("millis", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.select("event_id", scalar.console_date(F.col("millis")).alias("shown"))


@query("SELECT count(*) AS rows, count(*) AS ids, true AS fits FROM orders")
def fresh_run_ids(spark, sf_dir):
    """As many different ids of 36 characters as there are runs."""
    ids = read(spark, sf_dir, "orders").select(scalar.run_id().alias("id"))
    return ids.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.bool_and(F.length("id") == 36).alias("fits"))


@query("SELECT n_nationkey AS id, 0 AS exit_code, n_name AS stdout FROM nation")
def black_box_tasks(spark, sf_dir):
    """Scripts in two languages that write the nation's name."""
    n = read(spark, sf_dir, "nation")
    script = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("printf %s '"), "n_name", F.lit("'"))).otherwise(F.concat(F.lit("print('"), "n_name", F.lit("', end='')")))
    tasks = n.select(F.col("n_nationkey").cast("string").alias("id"), script.alias("command"), F.when(F.col("n_nationkey") % 2 == 0, "bash").otherwise("Python").alias("lang"))
    got = plugins.run_commands(tasks, allow=True)
    return got.select(F.col("id").cast("int").alias("id"), "exit_code", "stdout")


@query("SELECT count(*) AS rows, CAST(sum(len(n_name)) AS BIGINT) AS bytes FROM nation")
def staged_files(spark, sf_dir):
    """Files copied on the workers, with their sizes."""
    root, target = _written(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")), "n_nationkey"), scratch(spark)
    files = spark.read.text(root + "/*/*.txt", wholetext=True).select(F.col("_metadata.file_path").alias("source"))
    moved = logs.stage(files.withColumn("target", F.concat(F.lit(_uri(target)), F.lit("/"), F.regexp_extract("source", r"=(\d+)/", 1))))
    return moved.agg(F.count("*").alias("rows"), (F.sum("size") - F.count("*")).alias("bytes"))


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"

