"""Queries on logs: replay, ledgers, grids, shards, windows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.functions import text as X
from consensio.functions.keys import norm_endpoint, norm_key
from consensio.functions.keys import sql_norm_key as nk
from consensio.operators import completeness as G
from consensio.plans.base import TIDY, Book, r6
from consensio.sources.runs import MODEL_CLASSES, tidy
from consensio.sources.tables import table

book = Book()
_EP = "rtrim(coalesce(regexp_replace(endpoint, '^\\s+|\\s+$', '', 'g'), ''), '/')"
ENDPOINT = f"lower(regexp_extract({_EP}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', 0)) || substr({_EP}, len(regexp_extract({_EP}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', 0)) + 1)"


@book(f"""SELECT rec_type, endpoint, count(*) AS n_records, {r6('sum(cost_usd)')} AS cost_usd FROM (SELECT rec_type, {ENDPOINT} AS endpoint, cost_usd FROM agent_runs) GROUP BY ALL""")
def log_ledger(spark, sf):
    return table(spark, sf, "agent_runs").groupBy("rec_type", norm_endpoint("endpoint").alias("endpoint")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("cost_usd").alias("cost_usd"))


_IDS = f"{nk('task_id')} AS task, {nk('config')} AS config, {nk('model_role')} AS role, {nk('model_id')} AS model, coalesce(replicate_seed, seed, 0) AS seed, {ENDPOINT} AS endpoint"


def _ids(spark, sf):
    return table(spark, sf, "agent_runs").select("log_pos", "rec_type", norm_key("task_id").alias("task"), norm_key("config").alias("config"), norm_key("model_role").alias("role"), norm_key("model_id").alias("model"), F.coalesce("replicate_seed", "seed", F.lit(0)).alias("seed"), norm_endpoint("endpoint").alias("endpoint"), "cost_usd", "ts")


@book(f"SELECT config, count(*) AS n_runs, CAST(sum(first) AS BIGINT) AS first_pos FROM (SELECT {_IDS}, min(log_pos) AS first FROM agent_runs WHERE rec_type = 'run' GROUP BY ALL) GROUP BY ALL")
def replay_runs(spark, sf):
    runs = _ids(spark, sf).where("rec_type = 'run'")
    return G.first_wins(runs, ["endpoint", "task", "config", "role", "model", "seed"], "log_pos").groupBy("config").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("log_pos").alias("first_pos"))


_GRID = f"""WITH ids AS (SELECT rec_type, {_IDS} FROM agent_runs), obs AS (SELECT task, config, seed FROM ids WHERE rec_type = 'run' AND task IS NOT NULL AND config IS NOT NULL),
ex AS (SELECT t.task, c.config, s.seed, 5 AS least FROM (SELECT {nk('id')} AS task FROM tasks WHERE regime = 'H1_external' AND deleted_at IS NULL) t, (SELECT unnest(['single', 'sc']) AS config) c, (SELECT unnest([0, 1, 2]) AS seed) s),
seen AS (SELECT task, config, seed, count(*) AS n FROM obs GROUP BY ALL)"""


def _expected(spark, sf):
    t = table(spark, sf, "tasks").where("regime = 'H1_external' AND deleted_at IS NULL").select(norm_key("id").alias("task"))
    # the grid is declared: each task with two methods and three seeds
    return t.select("task", F.explode(F.array(F.lit("single"), F.lit("sc"))).alias("config")).select("task", "config", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(3)])).alias("seed")).withColumn("least", F.lit(5))


@book(f"{_GRID} SELECT config, status, count(*) AS n_cells FROM (SELECT coalesce(e.config, s.config) AS config, CASE WHEN e.task IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n < least THEN 'underfilled' ELSE 'ok' END AS status FROM ex e FULL JOIN seen s ON e.task = s.task AND e.config = s.config AND e.seed = s.seed) GROUP BY ALL")
def grid_completeness(spark, sf):
    runs = _ids(spark, sf).where("rec_type = 'run' AND task IS NOT NULL AND config IS NOT NULL").select("task", "config", "seed")
    return G.compare_grids(_expected(spark, sf), runs, ["task", "config", "seed"]).groupBy("config", "status").agg(F.count(F.lit(1)).alias("n_cells"))


@book(f"{_GRID} SELECT config, count(*) AS n_pending FROM ex WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.rec_type = 'job_done' AND i.task = ex.task AND i.config = ex.config AND i.seed = ex.seed) GROUP BY ALL")
def pending_jobs(spark, sf):
    done = _ids(spark, sf).where("rec_type = 'job_done'")
    return G.pending(_expected(spark, sf), done, ["task", "config", "seed"]).groupBy("config").agg(F.count(F.lit(1)).alias("n_pending"))


# the whole declared grid: six configs, three seeds, the models of the roster; the heterogeneous debate has a pool of all of them and 4 agents
_CONFIGS = ["single", "sc", "homogeneous-mad", "heterogeneous-mad", "verifier", "interpretation-diverse"]
_SEEDS, _POOLS, _AGENTS = [0, 1, 2], {"heterogeneous-mad": "pool"}, {"heterogeneous-mad": 4}
_ROSTER = sorted(MODEL_CLASSES)
_JOBS = f"""WITH ids AS (SELECT rec_type, {_IDS} FROM agent_runs), obs AS (SELECT rec_type, task, config, seed, CASE WHEN config = 'heterogeneous-mad' AND model IN {tuple(_ROSTER)} THEN 'pool' ELSE model END AS model FROM ids WHERE task IS NOT NULL AND config IS NOT NULL AND model IS NOT NULL),
cm AS (SELECT config, model FROM (SELECT unnest({_CONFIGS}) AS config), (SELECT unnest({_ROSTER}) AS model) WHERE config <> 'heterogeneous-mad' UNION ALL SELECT 'heterogeneous-mad', 'pool'),
ex AS (SELECT t.task, cm.config, cm.model, s.seed, CASE WHEN cm.config = 'heterogeneous-mad' THEN 4 ELSE 1 END AS need FROM (SELECT {nk('id')} AS task FROM tasks WHERE deleted_at IS NULL) t, cm, (SELECT unnest({_SEEDS}) AS seed) s),
seen AS (SELECT task, config, model, seed, count(*) AS n FROM obs WHERE rec_type = 'run' GROUP BY ALL)"""


def _jobs(spark, sf):
    t = table(spark, sf, "tasks").where("deleted_at IS NULL").select(norm_key("id").alias("task"))
    return G.job_grid(t, _CONFIGS, _SEEDS, _ROSTER, _POOLS, _AGENTS)


def _observed(spark, sf, kind: str):
    own = _ids(spark, sf).where(F.col("rec_type") == kind).where("task IS NOT NULL AND config IS NOT NULL AND model IS NOT NULL")
    return G.pooled_models(own, _POOLS, _ROSTER).select("task", "config", "model", "seed")


@book(f"{_JOBS} SELECT config, model, status, count(*) AS n_cells FROM (SELECT coalesce(e.config, s.config) AS config, coalesce(e.model, s.model) AS model, CASE WHEN e.task IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n < need THEN 'underfilled' WHEN n > need THEN 'overfilled' ELSE 'ok' END AS status FROM ex e FULL JOIN seen s ON e.task = s.task AND e.config = s.config AND e.model = s.model AND e.seed = s.seed) GROUP BY ALL")
def grid_counters(spark, sf):
    """Counters of the whole grid, by config and model."""
    cells = G.compare_grids(_jobs(spark, sf), _observed(spark, sf, "run"), ["task", "config", "model", "seed"], most="most")
    return cells.groupBy("config", "model", "status").agg(F.count(F.lit(1)).alias("n_cells"))


@book(f"{_JOBS} SELECT config, model, count(*) AS n_pending FROM ex WHERE NOT EXISTS (SELECT 1 FROM obs i WHERE i.rec_type = 'job_done' AND i.task = ex.task AND i.config = ex.config AND i.model = ex.model AND i.seed = ex.seed) GROUP BY ALL")
def pending_models(spark, sf):
    """Jobs of the whole grid that are not done, by config and model."""
    return G.pending(_jobs(spark, sf), _observed(spark, sf, "job_done"), ["task", "config", "model", "seed"]).groupBy("config", "model").agg(F.count(F.lit(1)).alias("n_pending"))


@book(f"WITH d AS (SELECT {_IDS} FROM agent_runs WHERE rec_type = 'job_done'), r AS (SELECT {_IDS}, log_pos FROM agent_runs WHERE rec_type = 'run') SELECT d.config, count(*) AS n_jobs, count(*) FILTER (n IS NULL) AS n_without_runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_runs FROM (SELECT DISTINCT task, config, model, seed, endpoint FROM d) d LEFT JOIN (SELECT task, config, model, seed, endpoint, count(*) AS n FROM r GROUP BY ALL) r ON d.task = r.task AND d.config = r.config AND d.model = r.model AND d.seed = r.seed AND d.endpoint = r.endpoint GROUP BY ALL")
def done_jobs(spark, sf):
    keys = ["task", "config", "model", "seed", "endpoint"]
    ids = _ids(spark, sf)
    runs = ids.where("rec_type = 'run'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    jobs = ids.where("rec_type = 'job_done'").select(*keys).distinct().join(runs, keys, "left")
    return jobs.groupBy("config").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("n").isNull()).alias("n_without_runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_runs"))


@book(f"WITH k AS (SELECT {nk('task_id')} AS task, {nk('config')} AS config, {nk('model_id')} AS model, seed, label, output FROM agent_runs WHERE rec_type = 'run'), m AS (SELECT task, config, model, seed, count(*) AS n_read, count(DISTINCT md5(coalesce(label, '~') || chr(31) || coalesce(output, '~'))) AS n_distinct FROM k GROUP BY ALL) SELECT config, CAST(sum(n_read) AS BIGINT) AS n_read, count(*) AS n_keys, count(*) FILTER (n_distinct > 1) AS n_conflicts FROM m GROUP BY ALL")
def shard_conflicts(spark, sf):
    r = table(spark, sf, "agent_runs").where("rec_type = 'run'").select(norm_key("task_id").alias("task"), norm_key("config").alias("config"), norm_key("model_id").alias("model"), "seed", "label", "output")
    m = G.merge_shards(r, ["task", "config", "model", "seed"], ["label", "output"])
    return m.groupBy("config").agg(F.sum("n_read").alias("n_read"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n_distinct") > 1).alias("n_conflicts"))


@book(f"SELECT log_pos, left(sha1(concat_ws(chr(31), coalesce({nk('task_id')}, ''), coalesce({nk('config')}, ''), coalesce({nk('model_role')}, ''), coalesce({nk('model_id')}, ''), coalesce(CAST(seed AS VARCHAR), ''))), 16) AS row_id FROM agent_runs WHERE rec_type = 'run'")
def row_ids(spark, sf):
    return table(spark, sf, "agent_runs").where("rec_type = 'run'").select("log_pos", X.row_id(norm_key("task_id"), norm_key("config"), norm_key("model_role"), norm_key("model_id"), F.col("seed")).alias("row_id"))


@book("SELECT CAST(user_id AS BIGINT) AS user_id, max(n) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY ALL")
def sliding_minute(spark, sf):
    """The most events of a user within any 60 seconds. Users are split by day first, with the minute before it, so no user is one group."""
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    day = 86_400_000_000
    own = F.floor(F.col("t") / day).cast("bigint")
    # events of a day's last minute are read by the next day too, as context only
    both = e.select("user_id", "t", own.alias("own"), F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") + 60_000_000) / day).cast("bigint")))).alias("day"))
    n = F.count(F.lit(1)).over(W.partitionBy("user_id", "day").orderBy("t").rangeBetween(-60_000_000, 0))
    return both.withColumn("n", n).where(F.col("own") == F.col("day")).groupBy("user_id").agg(F.max("n").alias("peak"))


@book("SELECT user_id, event_type, count(*) AS n, " + r6("sum(value)") + " AS total, " + r6("arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))") + " AS last_less_first FROM events GROUP BY ALL")
def first_and_last(spark, sf):
    """Counts, sums and the change from the first to the last value, without sorting a user's events."""
    by = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), (F.max_by("value", by) - F.min_by("value", by)).alias("last_less_first"))


@book("WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT user_id, " + r6("avg(step)") + " AS mean_step, count(step) AS n_steps FROM s GROUP BY ALL")
def mean_step(spark, sf):
    """Mean change from one value of a user to the next, added up in their order; a user is one group. slope_per_day needs none."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("step")).groupBy("user_id").agg(F.avg("step").alias("mean_step"), F.count("step").alias("n_steps"))


@book("SELECT user_id, " + r6("(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) * 86400000000.0 / nullif(max(epoch_us(ts)) - min(epoch_us(ts)), 0)") + " AS per_day FROM events WHERE value IS NOT NULL GROUP BY ALL")
def slope_per_day(spark, sf):
    """Change from the first to the last value of a user over the days between them, without sorting."""
    at, t = F.struct("ts", "event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    change = F.max_by("value", at) - F.min_by("value", at)
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id").agg((change * 86_400_000_000 / F.nullif(F.max(t) - F.min(t), F.lit(0))).alias("per_day"))


@book("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, count(*) AS own, " + r6("count(*) * 1.0 / any_value(u.n)") + " AS share FROM events JOIN u USING (user_id) GROUP BY ALL")
def share_of_user(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("own"))
    return by.withColumn("share", F.col("own") / F.sum("own").over(W.partitionBy("user_id")).cast("double"))


@book(f"""{TIDY}, h AS (SELECT task, ambiguity_k, domain FROM task_facts WHERE regime = 'H1_external'), r AS (SELECT *, row_number() OVER (PARTITION BY domain, ambiguity_k ORDER BY task) AS rn FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rn, ambiguity_k, task) AS place FROM r) SELECT domain, task, ambiguity_k, place FROM p WHERE place <= 12""")
def balanced_batch(spark, sf):
    """A batch of 12 tasks of each domain, in turn over ambiguity levels."""
    t = table(spark, sf, "tasks").where("regime = 'H1_external'").select(norm_key("id").alias("task"), F.col("ambiguity_level").alias("ambiguity_k"), "domain")
    t = t.withColumn("rn", F.row_number().over(W.partitionBy("domain", "ambiguity_k").orderBy("task")))
    return t.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("rn", "ambiguity_k", "task"))).where("place <= 12").select("domain", "task", "ambiguity_k", "place")


@book("WITH x AS (SELECT domain, id, ambiguity_level AS k, interpretations AS i, key_questions AS q FROM tasks) SELECT domain, count(*) AS n_tasks, count(*) FILTER (len(i) = (1 << k)) AS n_power_set, count(*) FILTER (len(list_filter(i, lambda e: e.is_target)) = 1) AS n_one_target, count(*) FILTER (len(list_distinct(list_transform(i, lambda e: e.id))) = len(i)) AS n_distinct_ids, " + r6("avg(k)") + " AS mean_k FROM x GROUP BY ALL")
def domain_certification(spark, sf):
    """Checks of the tasks of each domain."""
    i = F.col("interpretations")
    return table(spark, sf, "tasks").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.size(i) == F.pow(F.lit(2), F.col("ambiguity_level"))).alias("n_power_set"), F.count_if(F.size(F.filter(i, lambda x: x["is_target"])) == 1).alias("n_one_target"),
        F.count_if(F.size(F.array_distinct(i["id"])) == F.size(i)).alias("n_distinct_ids"), F.avg("ambiguity_level").alias("mean_k"),
    )


@book(f"WITH l AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda x: -abs(CAST(x AS DOUBLE))) AS p FROM embeddings) SELECT vec_id, label, {r6('exp(list_avg(p))')} AS confidence, {r6('1 - exp(list_avg(p))')} AS uncertainty FROM l")
def token_confidence(spark, sf):
    """Confidence of sequences from the log probabilities of their first five tokens, and one less it; the sequences are those of the vectors, below zero."""
    c = X.token_confidence(F.transform("embedding", lambda x: -F.abs(x.cast("double"))))
    return table(spark, sf, "embeddings").select("vec_id", "label", c.alias("confidence"), (1 - c).alias("uncertainty"))


@book(f"SELECT {nk('model')} AS model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, {r6('sum(cost_usd)')} AS cost_usd, {r6('sum(cost_usd) * 1000 / nullif(sum(tokens_in) + sum(tokens_out), 0)')} AS usd_per_1k FROM completions GROUP BY ALL")
def cost_ledger(spark, sf):
    c = table(spark, sf, "completions").groupBy(norm_key("model").alias("model")).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"))
    return c.withColumn("usd_per_1k", F.try_divide(F.col("cost_usd") * 1000, (F.col("tokens_in") + F.col("tokens_out")).cast("double")))


QUERIES, SQL = book.queries, book.sql
