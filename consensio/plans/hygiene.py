"""Queries p2_ and p3_: repeated deliveries and orphan references."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.functions.keys import norm_key
from consensio.functions.keys import sql_norm_key as nk
from consensio.operators.orphans import orphans
from consensio.operators.redelivery import keep_first, surplus_rows
from consensio.sources.tables import table

IDENTITY = ["task_id", "config", "model_role", "model_id"]


def _identity() -> dict:
    return {"rec_type": F.col("rec_type")} | {k: norm_key(k) for k in IDENTITY} | {"seed": F.col("seed")}


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "agent_runs").where(F.col("rec_type").isin("run", "job_done"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_rows(_delivered(spark, sf), _identity(), "log_pos", "ts").select("log_pos")


def p2_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the records that remain, by type and month."""
    rows = keep_first(_delivered(spark, sf), _identity(), "log_pos", "ts")
    return rows.groupBy("rec_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_kept"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "tasks")
    to = tasks.select(norm_key("id").alias("id"), "created_at", "deleted_at")
    checks = table(spark, sf, "gold_checks").select(norm_key("check_name").alias("id"), "registered_at", "retired_at")
    out = []
    for name, key, time in (("agent_runs", "log_pos", "ts"), ("surfacing_results", "result_id", "recorded_at")):
        refs = table(spark, sf, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col("task_id").alias("ref_key"), F.col(time).alias("at"), norm_key("task_id").alias("k"))
        out.append(orphans(refs, to, {"k": "id"}, at="at", born="created_at", gone="deleted_at"))
    refs = tasks.select(F.lit("tasks").alias("table_name"), F.col("id").alias("row_key"), F.explode("interpretations.gold_check").alias("ref_key"), F.col("created_at").alias("at")).withColumn("k", norm_key("ref_key"))
    out.append(orphans(refs, checks, {"k": "id"}, at="at", born="registered_at", gone="retired_at"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_key", "ref_key").distinct()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table and month of the referring row."""
    rows = _orphans(spark, sf).select("table_name", "row_key", "ref_key", "at").distinct()
    return rows.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose task, config and model no finished job has; what of a run's three is not known may be anything."""
    both = table(spark, sf, "agent_runs").select("log_pos", "rec_type", norm_key("task_id").alias("task"), norm_key("config").alias("config"), norm_key("model_id").alias("model"))
    runs, jobs = both.where("rec_type = 'run'"), both.where("rec_type = 'job_done'").select("task", "config", "model").distinct()
    keys = {k: k for k in ("task", "config", "model")}
    return orphans(runs, jobs, keys, match="partial").groupBy("config", "model").agg(F.count(F.lit(1)).alias("n_orphans"))


_ID = ", ".join(f"{nk(k)} AS {k}" for k in IDENTITY)
_RANKED = f"""SELECT log_pos, rec_type, ts, count(*) OVER w AS copies, row_number() OVER (w ORDER BY log_pos) AS nth,
  task_id IS NULL OR config IS NULL OR model_role IS NULL OR model_id IS NULL OR seed IS NULL AS anonymous
FROM (SELECT log_pos, rec_type, ts, seed, {_ID} FROM agent_runs WHERE rec_type IN ('run', 'job_done'))
WINDOW w AS (PARTITION BY rec_type, task_id, config, model_role, model_id, seed)"""


def _refs(name: str, key: str, time: str) -> str:
    return f"""SELECT '{name}' AS table_name, CAST(r.{key} AS VARCHAR) AS row_key, r.task_id AS ref_key, r.{time} AS seen_at FROM {name} r
WHERE {nk('r.task_id')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tasks t WHERE {nk('t.id')} = {nk('r.task_id')}
  AND NOT coalesce(t.created_at > r.{time}, false) AND NOT coalesce(t.deleted_at <= r.{time}, false))"""


_ORPHANS = f"""{_refs('agent_runs', 'log_pos', 'ts')} UNION {_refs('surfacing_results', 'result_id', 'recorded_at')} UNION
SELECT 'tasks', r.id, r.ref_key, r.created_at FROM (SELECT id, created_at, unnest(interpretations).gold_check AS ref_key FROM tasks) r
WHERE {nk('r.ref_key')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gold_checks g WHERE {nk('g.check_name')} = {nk('r.ref_key')}
  AND NOT coalesce(g.registered_at > r.created_at, false) AND NOT coalesce(g.retired_at <= r.created_at, false))"""

QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}
SQL = {
    "p2_found": f"SELECT log_pos FROM ({_RANKED}) WHERE nth > 1 AND NOT anonymous",
    "p2_kept": f"SELECT rec_type, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_kept FROM ({_RANKED}) WHERE nth = 1 OR anonymous GROUP BY ALL",
    "p3_composite": f"WITH b AS (SELECT log_pos, rec_type, {nk('task_id')} AS task, {nk('config')} AS config, {nk('model_id')} AS model FROM agent_runs) SELECT config, model, count(*) AS n_orphans FROM b r WHERE rec_type = 'run' AND (task IS NOT NULL OR config IS NOT NULL OR model IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM b j WHERE j.rec_type = 'job_done' AND (r.task IS NULL OR j.task = r.task) AND (r.config IS NULL OR j.config = r.config) AND (r.model IS NULL OR j.model = r.model)) GROUP BY ALL",
    "p3_found": f"SELECT DISTINCT table_name, row_key, ref_key FROM ({_ORPHANS})",
    "p3_report": f"SELECT table_name, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans FROM (SELECT DISTINCT table_name, row_key, ref_key, seen_at FROM ({_ORPHANS})) GROUP BY ALL",
}
