"""Queries on what surrounds the analysis: selections, contrasts of runs, dependence tables, checks, samples, logs as files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from consensio.functions import text as X
from consensio.functions.keys import norm_key
from consensio.functions.keys import sql_norm_key as nk
from consensio.operators import checks as K
from consensio.operators import completeness as G
from consensio.operators import contrasts as C
from consensio.operators import dependence as D
from consensio.operators import evaluation as E
from consensio.operators import filters as P
from consensio.operators import gee as GE
from consensio.operators import linear as LM
from consensio.operators import nulls as N
from consensio.operators import resample as R
from consensio.operators import studies as S
from consensio.operators.durable import cut, scratch
from consensio.operators.labels import CELL, cell_measures, cells, label_counts, modal_wrong
from consensio.operators.order import null_safe_join, percentiles
from consensio.plans.base import CELL_KEYS, CELLS, TIDY, Book, measures_sql, r6, weight_sql
from consensio.plans.consensus import B_ITEMS, B_VERDICT, SEED, _complete
from consensio.plans.consensus import SQL as CONSENSUS_SQL
from consensio.sources import runlog as L
from consensio.sources.runs import tidy
from consensio.sources.tables import table

book = Book()

# selections

_PRIMARY, _ASKED = ["single", "sc", "homogeneous-mad", "heterogeneous-mad"], [0, 1, 2]


@book(f"{TIDY} SELECT method, count(*) FILTER (NOT coalesce(family = constructor_family, false)) AS n_kept, count(*) FILTER (coalesce(family = constructor_family, false)) AS n_dropped FROM tidy WHERE method IN {tuple(_PRIMARY)} AND seed IN {tuple(_ASKED)} GROUP BY ALL")
def primary_runs(spark, sf):
    """Rows of the primary methods and requested seeds, kept and held out as their family built the task."""
    own = P.of_seeds(P.of_methods(tidy(spark, sf), _PRIMARY), _ASKED)
    return own.groupBy("method").agg(F.count_if(~P.held_out()).alias("n_kept"), F.count_if(P.held_out()).alias("n_dropped"))


# contrasts of two runs

_NEW, _BASE = ["verifier", "interpretation-diverse"], "heterogeneous-mad"


@book(f"""{CELLS}, b AS (SELECT unnest(range({B_ITEMS})) AS b), i AS (SELECT task, method, regime, avg(cd_primary) AS v FROM cells WHERE regime IN ('H1_external', 'H2_derivable') GROUP BY ALL),
g AS (SELECT c.config, r.regime FROM (SELECT unnest({_NEW}) AS config) c, (SELECT unnest(['H1_external', 'H2_derivable']) AS regime) r),
d AS (SELECT a.method AS config, a.regime, a.task, a.v - b.v AS delta FROM i a JOIN i b ON a.task = b.task AND a.regime = b.regime AND b.method = '{_BASE}' WHERE a.method IN {tuple(_NEW)}),
m AS (SELECT config, regime, b, sum(w * delta) / nullif(sum(w), 0) AS mean FROM (SELECT d.*, b, {weight_sql(SEED, 'b', 'task')} AS w FROM d, b) GROUP BY ALL),
ci AS (SELECT config, regime, list_sort(list(mean)) AS s, count(mean) AS n FROM m WHERE mean IS NOT NULL GROUP BY ALL)
SELECT g.config, g.regime, (SELECT count(*) FROM i WHERE method = g.config AND regime = g.regime) AS n_items, {r6('(SELECT avg(v) FROM i WHERE method = g.config AND regime = g.regime)')} AS mean_cd, {r6(f"(SELECT avg(v) FROM i WHERE method = '{_BASE}' AND regime = g.regime)")} AS baseline_cd,
(SELECT count(*) FROM d WHERE d.config = g.config AND d.regime = g.regime) AS n_delta, {r6('(SELECT avg(delta) FROM d WHERE d.config = g.config AND d.regime = g.regime)')} AS delta, {r6('s[greatest(0, CAST(floor(n * 0.025) AS INT) - 1) + 1]')} AS lo, {r6('s[least(n - 1, CAST(floor(n * 0.975) AS INT)) + 1]')} AS hi FROM g LEFT JOIN ci ON ci.config = g.config AND ci.regime = g.regime""")
def run_contrasts(spark, sf):
    """New configurations of one run against the baseline method of another, by items that both have."""
    own = cells(tidy(spark, sf))
    return C.run_contrasts(own, own, _NEW, _BASE, B_ITEMS, SEED)


# dependence

_KAPPA = CONSENSUS_SQL["fleiss_kappa"]


@book(f"{CELLS}, kk AS ({_KAPPA}) SELECT {', '.join(f'c.{k}' for k in CELL_KEYS.split(', '))}, CAST(n_agents AS BIGINT) AS n_agents, {r6('cd_primary')} AS cd_primary, {r6('pairwise_wrong')} AS pairwise_wrong, {r6('kappa')} AS kappa FROM cells c LEFT JOIN kk ON c.method IS NOT DISTINCT FROM kk.method AND c.model_class = kk.model_class AND c.seed = kk.seed")
def dependence_cells(spark, sf):
    """Cells with their own agreement and the kappa of their group."""
    return D.dependence_cells(label_counts(tidy(spark, sf)))


@book()
def dependence_by_regime(spark, sf):
    """Intraclass correlation, effective size and agreement beyond independence, by regime."""
    t = tidy(spark, sf)
    counts = cut(label_counts(_complete(spark, sf), [*CELL, "model"]))
    pool = t.where("model IS NOT NULL").groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))
    gap = N.gap(counts, CELL, N.redrawn(counts, CELL, pool, ["regime"], "model", B_VERDICT, SEED), ["regime"])
    return null_safe_join(D.dependence_summary(label_counts(t.where("regime IS NOT NULL"))), gap.drop("n_cells"), ["regime"], "left")


_ICC_T = f"""{CELLS}, w AS (SELECT c.regime, t.target, n_agents, n_agents - n_target AS n_wrong FROM cells c JOIN (SELECT DISTINCT task, target FROM tidy) t USING (task) WHERE c.regime IS NOT NULL),
g AS (SELECT regime, target, count(*) AS k, sum(n_agents) AS nn, sum(n_wrong) AS s, sum(n_wrong * n_wrong * 1.0 / n_agents) AS q, sum(1.0 / n_agents) AS inv FROM w GROUP BY ALL),
m AS (SELECT *, (q - s * s * 1.0 / nn) / nullif(k - 1, 0) AS msb, (s - q) / nullif(nn - k, 0) AS msw, k / inv AS n0 FROM g),
i AS (SELECT regime, avg(CASE WHEN k >= 2 THEN (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) END) AS icc, sum(k) AS n_cells, sum(nn) * 1.0 / sum(k) AS mean_agents FROM m GROUP BY ALL)"""


@book(f"{_ICC_T}, r AS (SELECT *, round_even(mean_agents, 0) AS r FROM i) SELECT regime, CAST(n_cells AS BIGINT) AS n_cells, {r6('icc')} AS icc, {r6('CASE WHEN icc IS NULL THEN NULL WHEN r <= 1 OR 1 + (r - 1) * icc <= 0 THEN r ELSE r / (1 + (r - 1) * icc) END')} AS n_eff FROM r")
def icc_by_target(spark, sf):
    """Correlation within cells, as the mean over the targets of a regime, and the effective number of agents."""
    return D.dependence_summary(label_counts(tidy(spark, sf).where("regime IS NOT NULL")))


# ensembles

@book(f"""{TIDY}, c AS (SELECT task, method, target, label, count(*) AS n FROM tidy WHERE method IS NOT NULL GROUP BY ALL), m AS ({measures_sql('c', 'task, method')}), f AS (SELECT task, method, arg_min(label, (-n, label)) AS foil FROM c WHERE label <> target AND label <> 'I_perp' GROUP BY ALL)
SELECT m.task, m.method, {r6('cd_frozen')} AS cd_frozen, {r6('cd_primary')} AS cd_primary, {r6('iperp_rate')} AS iperp_rate, {r6('n_target * 1.0 / n_agents')} AS resolve_rate, foil FROM m LEFT JOIN f USING (task, method)""")
def ensemble_rows(spark, sf):
    """A diagnostic row for each task and method, with the wrong label most agents agree on."""
    counts = label_counts(tidy(spark, sf).where("method IS NOT NULL"), ["task", "method"])
    m = cell_measures(counts, ["task", "method"]).select("task", "method", "cd_frozen", "cd_primary", "iperp_rate", (F.col("n_target") / F.col("n_agents")).alias("resolve_rate"))
    return m.join(modal_wrong(counts, ["task", "method"]).drop("n_foil"), ["task", "method"], "left")


# answers against checks

CHECKS = K.Checks()
for _d in ("data_analysis", "policy_qa"):
    CHECKS.add(_d, "I0")(lambda a: a.rlike(r"\d\.\d\d\z"))
    CHECKS.add(_d, "I1")(lambda a: a.rlike(r"\d%\z"))
CHECKS.add("code_spec", "I0")(lambda a: a.contains("return"))
CHECKS.add("code_spec", "I1")(lambda a: a.contains("yield") | a.contains("print("))
_PASS = r"""CASE WHEN domain IN ('data_analysis', 'policy_qa') THEN list_filter([CASE WHEN regexp_matches(output, '\d\.\d\d\z') THEN 'I0' END, CASE WHEN regexp_matches(output, '\d%\z') THEN 'I1' END], lambda x: x IS NOT NULL)
 WHEN domain = 'code_spec' THEN list_filter([CASE WHEN contains(output, 'return') THEN 'I0' END, CASE WHEN contains(output, 'yield') OR contains(output, 'print(') THEN 'I1' END], lambda x: x IS NOT NULL) ELSE [] END"""


@book(f"{TIDY}, p AS (SELECT domain, {_PASS} AS passed FROM tidy) SELECT domain, CASE WHEN len(passed) = 1 THEN passed[1] ELSE 'I_perp' END AS label, count(*) AS n FROM p GROUP BY ALL")
def checked_labels(spark, sf):
    """Labels of answers from checks that are registered by domain."""
    return K.label_answers(tidy(spark, sf).drop("label"), CHECKS, "domain", "output").groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))


@book("SELECT CAST(CASE WHEN contains(lower(output), 'candidate 0') THEN 0 WHEN contains(lower(output), 'candidate 1') THEN 1 WHEN contains(lower(output), 'candidate 2') THEN 2 ELSE 0 END AS INT) AS chosen, count(*) AS n FROM agent_runs WHERE rec_type = 'run' GROUP BY ALL")
def verifier_choices(spark, sf):
    return table(spark, sf, "agent_runs").where("rec_type = 'run'").groupBy(F.coalesce(S.selected_candidate(F.col("output"), 3), F.lit(0)).alias("chosen")).agg(F.count(F.lit(1)).alias("n"))


_TAIL = r"list_transform(regexp_extract_all(output, '(?i)\bFINAL\s+ANSWER\s*[:=]\s*([^\n]*)', 1), lambda t: CASE WHEN regexp_matches(t, '^\(?\s*[-+]?\s*\$?\s*[-+]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*\)?[.\s*]*$') THEN CAST(round(CAST(replace(regexp_extract(t, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DECIMAL(30, 6)) * 100, 0) AS BIGINT) * CASE WHEN (len(regexp_replace(t, '[^-]', '', 'g')) + CASE WHEN starts_with(t, '(') THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END END)"


@book(f"WITH a AS (SELECT log_pos, {_TAIL} AS a FROM agent_runs WHERE rec_type = 'run' AND output IS NOT NULL) SELECT log_pos, CAST(len(a) AS INT) AS n_amounts, CASE WHEN len(a) > 0 AND len(list_filter(a, lambda x: x IS NULL)) = 0 AND len(list_distinct(a)) = 1 THEN a[1] END AS cents FROM a WHERE len(a) > 0")
def final_amounts(spark, sf):
    """Amounts of FINAL ANSWER lines, in cents, where all of an answer agree."""
    a = table(spark, sf, "agent_runs").where("rec_type = 'run' AND output IS NOT NULL").select("log_pos", X.final_amounts(F.col("output")).alias("a"))
    return a.where(F.size("a") > 0).select("log_pos", F.size("a").alias("n_amounts"), X.agreed_amount(F.col("a")).alias("cents"))


@book("SELECT p_partkey, 'num:' || CAST(CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS VARCHAR) AS signature FROM part")
def signatures(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.amount_signature(F.col("p_retailprice")).alias("signature"))


@book("SELECT p_partkey, CAST(list_reduce(list_transform(str_split(sha256(p_name), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda acc, x: (acc * 16 + x) % 7) AS INT) AS place FROM part WHERE p_name IS NOT NULL")
def hashed_places(spark, sf):
    """A place of each name by all bits of its SHA-256."""
    return table(spark, sf, "part").where("p_name IS NOT NULL").select("p_partkey", X.sha_index(F.col("p_name"), 7).alias("place"))


_FORMAT = f"""len(list_intersect(regexp_extract_all(lower(domain), '([a-z0-9]+)', 1), {X.FORMAT_WORDS})) > 0 OR {' OR '.join(f"contains(lower(domain), '{p}')" for p in X.FORMAT_PHRASES)}
OR (len(key_questions) > 0 AND len(list_filter(key_questions, lambda v: len(list_intersect(regexp_extract_all(lower(coalesce(v, '')), '([a-z0-9]+)', 1), {X.LANGUAGE_WORDS})) = 0)) = 0)"""


@book(f"SELECT {nk('id')} AS task, coalesce({_FORMAT}, false) AS is_format FROM tasks")
def format_dimensions(spark, sf):
    """Tasks whose questions, as values of a dimension of their domain, are all about languages."""
    return table(spark, sf, "tasks").select(norm_key("id").alias("task"), X.is_format_dimension(F.col("domain"), F.col("key_questions")).alias("is_format"))


@book("SELECT count(*) FILTER (l_discount IS NOT DISTINCT FROM l_tax OR abs(l_discount - l_tax) < 1e-9) AS n_same_doubles, count(*) FILTER (l_linenumber IS NOT DISTINCT FROM CAST(l_quantity AS INT)) AS n_same_ints FROM lineitem")
def typed_comparison(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.agg(F.count_if(X.same_value(F.col("l_discount"), F.col("l_tax"), "double")).alias("n_same_doubles"), F.count_if(X.same_value(F.col("l_linenumber"), F.col("l_quantity").cast("int"), "int")).alias("n_same_ints"))


@book("SELECT a.n_nationkey, lower(trim(a.n_name)) IS NOT DISTINCT FROM lower(trim('  ' || upper(a.n_name))) AND round_even(a.n_nationkey * 1.001 * 100, 0) IS NOT DISTINCT FROM round_even(a.n_nationkey * 1.0 * 100, 0) AS same FROM nation a")
def structured_comparison(spark, sf):
    """Answers as structs: names without case and space, amounts to the cent."""
    n = F.col("n_nationkey")
    got = F.struct(F.concat(F.lit("  "), F.upper("n_name")).alias("name"), (n * 1.001).cast("double").alias("sum"))
    want = F.struct(F.col("n_name").alias("name"), n.cast("double").alias("sum"))
    return table(spark, sf, "nation").select("n_nationkey", X.same_answer(got, want, {"name": "string", "sum": "double"}).alias("same"))


@book("SELECT log_pos, 0.5 + (((seed % 50) + 50) % 50) / 100.0::DOUBLE AS conf FROM agent_runs WHERE rec_type = 'run' AND seed IS NOT NULL")
def stand_in_confidence(spark, sf):
    """The confidence that a run without a model states: it depends on the seed alone."""
    return table(spark, sf, "agent_runs").where("rec_type = 'run' AND seed IS NOT NULL").select("log_pos", (F.lit(0.5) + F.pmod(F.col("seed"), F.lit(50)) / 100.0).alias("conf"))


# samples for coders

_SIGNAL = f"{TIDY}, o AS (SELECT uid, model_class AS signal, md5('42|' || uid) AS h FROM tidy), r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY h, uid) AS k FROM o), f AS (SELECT * FROM r WHERE k <= greatest(1, 60 // (SELECT count(DISTINCT signal) FROM o)))"


@book(f"{_SIGNAL}, x AS (SELECT uid, signal, row_number() OVER (ORDER BY h, uid) AS k FROM r WHERE uid NOT IN (SELECT uid FROM f)) SELECT uid, signal FROM f UNION ALL SELECT uid, signal FROM x WHERE k <= 60 - (SELECT count(*) FROM f)")
def signal_sample(spark, sf):
    """Sixty rows for coding: as many of each signal, and the rest from all that are left."""
    t = tidy(spark, sf).select("uid", F.col("model_class").alias("signal"))
    return E.signal_sample(t, "signal", "uid", 60, 42).select("uid", "signal")


_NO_TEXT = "''"
_MASKED = "regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\\bInterpretation\\s+I\\d+(?:\\s*\\([^)\\n]{{0,80}}\\))?', '[interpretation]', 'g'), '\\bI_perp\\b', '[interpretation]', 'g'), '\\bI[0-7]\\b', '[option]', 'g')"


@book(f"SELECT log_pos, coalesce(t.domain, 'UNKNOWN') AS domain, {_MASKED.format(f'coalesce(t.prompt, {_NO_TEXT})')} AS task_prompt, {_MASKED.format(f'coalesce(output, {_NO_TEXT})')} AS model_output FROM agent_runs a LEFT JOIN (SELECT {nk('id')} AS task, domain, prompt FROM tasks) t ON t.task = {nk('a.task_id')} WHERE rec_type = 'run'")
def coding_sheet(spark, sf):
    """Answers with their prompts for human coders; labels are masked, an unknown task is UNKNOWN."""
    return E.coding_rows(table(spark, sf, "agent_runs").where("rec_type = 'run'").select("log_pos", norm_key("task_id").alias("task"), "output"), table(spark, sf, "tasks").select(norm_key("id").alias("task"), "domain", "prompt"))


# grids

@book(f"""WITH o AS (SELECT {nk('task_id')} AS task, {nk('config')} AS config, coalesce(replicate_seed, seed, 0) AS seed, count(*) AS n FROM agent_runs WHERE rec_type = 'run' GROUP BY ALL), e AS (SELECT t.task, c.config, s.seed FROM (SELECT {nk('id')} AS task FROM tasks WHERE regime = 'H1_external' AND deleted_at IS NULL) t, (SELECT unnest({_PRIMARY}) AS config) c, (SELECT unnest({_ASKED}) AS seed) s),
j AS (SELECT coalesce(e.task, o.task) AS task, coalesce(e.config, o.config) AS config, coalesce(e.seed, o.seed) AS seed, coalesce(n, 0) AS n, CASE WHEN e.task IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n < 4 THEN 'underfilled' WHEN n > 4 THEN 'overfilled' ELSE 'ok' END AS status FROM e FULL JOIN (SELECT * FROM o WHERE task IS NOT NULL AND config IS NOT NULL) o ON e.task = o.task AND e.config = o.config AND e.seed = o.seed),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY task, config, seed) AS place FROM j WHERE status <> 'ok') SELECT status, place, task, config, seed, n FROM r WHERE place <= 50""")
def grid_lists(spark, sf):
    """The first fifty cells of each kind that are not as they should be: a report."""
    t = table(spark, sf, "tasks").where("regime = 'H1_external' AND deleted_at IS NULL").select(norm_key("id").alias("task"))
    grid = t.select("task", F.explode(F.array(*[F.lit(c) for c in _PRIMARY])).alias("config")).select("task", "config", F.explode(F.array(*[F.lit(s).cast("bigint") for s in _ASKED])).alias("seed"), F.lit(4).alias("least"), F.lit(4).alias("most"))
    seen = table(spark, sf, "agent_runs").where("rec_type = 'run'").select(norm_key("task_id").alias("task"), norm_key("config").alias("config"), F.coalesce("replicate_seed", "seed", F.lit(0)).alias("seed")).dropna(subset=["task", "config"])
    return G.listed(G.compare_grids(grid, seen, ["task", "config", "seed"], most="most"), ["task", "config", "seed"], 50)


# interventions

_REC = f"""{TIDY}, rec AS (SELECT task, model, any_value(regime) AS stratum, min(label) AS b, max(label) AS o, count(DISTINCT label) AS k, count(*) AS n FROM tidy GROUP BY ALL), own AS (SELECT *, k > 1 AS disagree, n > 3 AS often FROM rec WHERE model IS NOT NULL)"""
_DROP = "(SELECT x.task, coalesce(max(n) FILTER (x.l <> 'I0' AND x.l <> 'I_perp'), 0) * 1.0 / sum(n) AS cd FROM (SELECT task, {0} AS l, count(*) AS n FROM own GROUP BY ALL) x GROUP BY ALL)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    g = tidy(spark, sf).groupBy(F.col("task").alias("task_id"), "model").agg(F.first("regime").alias("stratum"), F.min("label").alias("bl"), F.max("label").alias("ol"), F.array_sort(F.collect_set("label")).alias("seed_labels"), F.count(F.lit(1)).alias("n"))
    rows = g.select("task_id", "stratum", (F.col("n") > 3).alias("is_flagged"), F.lit(0.0).alias("h_seed"), "seed_labels", F.lit(0).alias("n_surfaced"), F.struct(F.col("bl").alias("baseline_label"), F.col("ol").alias("oracle_label")).alias("b2"), F.col("model").isNull().alias("na"))
    return S.clarify(rows)


@book(f"{_REC} SELECT own.task AS task_id, any_value(stratum) AS stratum, count(*) AS n_rows, {r6('avg(CASE WHEN often THEN 1.0 ELSE 0 END)')} AS lpp_gated, 1.0::DOUBLE AS always, {r6('avg(CASE WHEN disagree THEN 1.0 ELSE 0 END)')} AS self_consistency_gated, {r6("avg(CASE WHEN o = 'I0' THEN 1.0 ELSE 0 END)")} AS i0_hit, {r6('any_value(db.cd)')} AS cd_baseline, {r6('any_value(dor.cd)')} AS cd_oracle FROM own JOIN {_DROP.format('b')} db ON db.task = own.task JOIN {_DROP.format('o')} dor ON dor.task = own.task GROUP BY own.task")
def interventions(spark, sf):
    """Rates of asking and agreement before and after, by task; the answers before and after are the first and last labels by name."""
    return S.intervention_items(_records(spark, sf), ["lpp_gated", "always", "self_consistency_gated"]).drop("h_seed")


@book(f"{_REC}, it AS (SELECT own.task, any_value(stratum) AS stratum, avg(CASE WHEN o = 'I0' THEN 1.0 ELSE 0 END) AS hit, any_value(db.cd) AS b, any_value(dor.cd) AS o FROM own JOIN {_DROP.format('b')} db ON db.task = own.task JOIN {_DROP.format('o')} dor ON dor.task = own.task GROUP BY own.task) SELECT count(*) AS n, {r6('avg(b)')} AS baseline, {r6('avg(o)')} AS oracle, {r6('avg(b - o)')} AS drop, {r6('avg(hit)')} AS i0_hit, count(*) FILTER (o > 0) AS n_unresolved, count(*) FILTER (hit < 1) AS n_partial FROM it WHERE stratum = 'H1_external'")
def intervention_drop(spark, sf):
    return S.paired_drop(S.intervention_items(_records(spark, sf), ["always"]), "H1_external")


# trials

@book("""WITH e AS (SELECT user_id, event_id, ts, CAST(value AS BIGINT) % 5 + 1 AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT CAST(user_id AS BIGINT) AS participant_id, count(*) AS n_trials, CAST(max(r) - 1 AS BIGINT) AS last_index, CAST(CASE WHEN count(confidence) > 1 AND min(confidence) = max(confidence) THEN 1 ELSE 0 END AS INT) AS straightline, """ + r6("round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 1)") + """ AS total_time FROM e GROUP BY ALL""")
def trials_flat(spark, sf):
    """Rounds of participants with what an export adds, summed up; an event is a round."""
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    rounds = e.select(F.col("user_id").cast("bigint").alias("participant_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("round_number"), (F.col("value").cast("bigint") % 5 + 1).alias("confidence"), F.lit(1000).alias("rt_ms"), t.alias("t_start"), t.alias("t_end"))
    flat = S.flat_trials(rounds)
    return flat.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_trials"), F.max("order_index").cast("bigint").alias("last_index"), F.max("straightline_confidence").alias("straightline"), F.max("total_time_sec").alias("total_time"))


@book()
def trial_effects(spark, sf):
    """Effects of the conditions on accepting, with participants as clusters; trials of customers as in trials_csv."""
    c = table(spark, sf, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    k, i = F.col("k"), F.col("i")
    t = c.select(k, F.col("i"), F.when((k + i) % 3 == 1, 1.0).otherwise(0.0).alias("fake"), F.when((k + i) % 3 == 2, 1.0).otherwise(0.0).alias("dep"), (i % 2).cast("double").alias("complete"), ((k + i * i) % 2).cast("double").alias("accept"))
    d, names = LM.design(t, ["fake", "dep", "complete"], None, [("complete", "fake"), ("complete", "dep")])
    r = GE.fit(d, "accept", names, "k", True)
    rows = [(n, *GE.contrast(r, w), r["status"]) for n, w in (("fake", {"fake": 1.0}), ("dep less fake", {"dep": 1.0, "fake": -1.0}), ("complete x fake", {"complete:fake": 1.0}), ("complete x dep less fake", {"complete:dep": 1.0, "complete:fake": -1.0}))]
    return spark.createDataFrame(rows, "effect string, estimate double, se double, z double, status string")


_TRIAL = "SELECT c_custkey AS p, i AS o, CASE (c_custkey + i) % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'fake' ELSE 'dep' END AS condition, CASE WHEN (c_custkey * 7 + i) % 97 = 0 THEN NULL ELSE (c_custkey + i * i) % 2 END AS accept, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS attention FROM customer, (SELECT unnest(range(14)) AS i)"


@book(f"WITH t AS ({_TRIAL}), k AS (SELECT p FROM t GROUP BY p HAVING count(accept) = 14 AND min(attention) = 1) SELECT condition, count(*) AS n, {r6('avg(accept)')} AS accept, {r6('avg(accept) FILTER (o = 0)')} AS accept_first FROM t SEMI JOIN k USING (p) WHERE accept IS NOT NULL GROUP BY ALL")
def trials_csv(spark, sf):
    """Trials written as CSV and read again, with exclusions and acceptance by condition; fourteen trials for each customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    k, i = F.col("k"), F.col("i")
    condition = F.when((k + i) % 3 == 0, "single").when((k + i) % 3 == 1, "fake").otherwise("dep")
    own = {"participant_id": k.cast("string"), "item_id": i.cast("string"), "condition": condition, "accept": F.when((k * 7 + i) % 97 != 0, (k + i * i) % 2), "order_index": i, "passed_attention": F.when(k % 11 == 0, 0).otherwise(1)}
    columns = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in L.TRIAL]
    path = scratch(spark, "trials")
    c.select(*columns).write.option("header", True).csv(path)
    kept = L.exclude_trials(L.read_trials(spark, path))
    return L.trial_summary(kept).drop("gap_correct")


# logs as files

_LOG = {"type": "rec_type", "task_id": "task_id", "config": "config", "model_role": "model_role", "model_id": "model_id", "output": "output", "label": "label", "verbalized_conf": "verbalized_conf", "logit_conf": "logit_conf", "seed": "seed", "replicate_seed": "replicate_seed", "endpoint": "endpoint", "cost_usd": "cost_usd"}
_RUN_LOG = T.StructType([f for f in L.RUN_LOG if f.name != "_corrupt"])


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "agent_runs").select(*[F.col(c).alias(n) for n, c in _LOG.items()])


@book(f"SELECT rec_type AS type, count(*) AS n, {r6('sum(cost_usd)')} AS cost_usd FROM agent_runs GROUP BY ALL")
def jsonl_log(spark, sf):
    """The log as JSON lines, read back with a malformed line and an unknown record among them."""
    path = scratch(spark, "log")
    L.write_lines(_log(spark, sf), path)
    spark.createDataFrame([("{not json",), ('{"type": "other"}',), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return L.read_run_log(spark, f"{path}").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost_usd"))


@book("WITH i AS (SELECT DISTINCT rec_type, task_id, config, model_role, model_id, seed FROM agent_runs WHERE rec_type <> 'cost_delta') SELECT count(*) AS n_first, 0 AS n_again, count(*) AS n_read FROM i")
def jsonl_appended(spark, sf):
    """Records appended twice: the second time nothing is new."""
    path, identity = scratch(spark, "append"), ["type", "task_id", "config", "model_role", "model_id", "seed"]
    new = _log(spark, sf).where("type <> 'cost_delta'")
    L.write_lines(new.limit(0), path)
    first, again = L.append_new(new, path, identity), L.append_new(new, path, identity)
    n = L.read_lines(spark, path, L.RUN_LOG).count()
    return spark.createDataFrame([(first, again, n)], "n_first bigint, n_again int, n_read bigint")


@book("SELECT rec_type AS type, count(*) AS n FROM (SELECT DISTINCT rec_type, task_id, config, model_role, model_id, seed FROM agent_runs) GROUP BY ALL")
def jsonl_union(spark, sf):
    """Distinct lines of two overlapping files."""
    a, b = scratch(spark, "a"), scratch(spark, "b")
    keys = _log(spark, sf).select("type", "task_id", "config", "model_role", "model_id", "seed")
    keys.write.json(a)
    keys.where("type = 'run'").write.json(b)
    return L.union_lines(spark, [a, b], _RUN_LOG).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@book("WITH k AS (SELECT log_pos, label, endpoint FROM agent_runs WHERE rec_type = 'run') SELECT 2 AS n_shards, (SELECT count(*) FROM k) + (SELECT count(*) FROM k WHERE label = 'I0') AS n_read, (SELECT count(*) FROM k) AS n_keys, 0 AS n_conflicts, (SELECT count(*) FROM k WHERE label = 'I0') AS n_duplicates")
def jsonl_shards(spark, sf):
    """Two shards with a common part, read strictly and merged."""
    path = scratch(spark, "shards")
    rows = table(spark, sf, "agent_runs").where("rec_type = 'run'").select("log_pos", "label")
    rows.coalesce(1).write.json(f"{path}/one")
    rows.where("label = 'I0'").coalesce(1).write.json(f"{path}/two")
    shards = L.read_shards(spark, [f"{path}/one", f"{path}/two"], T.StructType([T.StructField("log_pos", T.LongType()), T.StructField("label", T.StringType())]), ["log_pos"])
    m = G.merge_shards(shards, ["log_pos"], ["label"])
    n = shards.agg(F.countDistinct("shard").cast("int").alias("n_shards"))
    out = m.agg(F.sum("n_read").alias("n_read"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n_distinct") > 1).cast("int").alias("n_conflicts"), F.sum(F.col("n_read") - F.col("n_distinct")).alias("n_duplicates"))
    return n.join(F.broadcast(out))


@book("SELECT domain, count(*) AS n, CAST(sum(len(interpretations)) AS BIGINT) AS n_interpretations FROM tasks GROUP BY ALL")
def jsonl_tasks(spark, sf):
    path = scratch(spark, "tasks")
    L.write_lines(table(spark, sf, "tasks").select(*[f.name for f in L.TASK]), path)
    return L.read_tasks(spark, path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("interpretations")).alias("n_interpretations"))


# coders, jobs, shards, certification, costs

_A, _B = "ostrel/lumen-large", "quorra/glass-xl"


@book(f"""{TIDY}, c AS (SELECT task, model, avg(CASE WHEN label = target THEN 1.0 ELSE 0.0 END) > 0.5 AS hit FROM tidy GROUP BY ALL), p AS (SELECT a.hit AS a, b.hit AS b FROM c a JOIN c b ON a.task = b.task WHERE a.model = '{_A}' AND b.model = '{_B}'),
k AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS pb FROM p), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM k) SELECT n, {r6('po')} AS po, {r6('pe')} AS pe, {r6('CASE WHEN pe < 1 - 1e-12 THEN (po - pe) / (1 - pe) END')} AS kappa FROM e""")
def coder_kappa(spark, sf):
    """Agreement of two coders on the tasks that both coded; the coders are two models, and a task is coded by the majority of their answers."""
    c = tidy(spark, sf).where(F.col("model").isin(_A, _B)).groupBy("task", "model").agg((F.avg((F.col("label") == F.col("target")).cast("double")) > 0.5).alias("hit"))
    return E.cohen_kappa(E.two_coders(c.where(F.col("model") == _A), c.where(F.col("model") == _B), "task", "hit"), "a", "b")


@book(f"WITH i AS (SELECT rec_type, {nk('task_id')} AS task, {nk('config')} AS config, {nk('model_id')} AS model, {nk('model_role')} AS role, seed, replicate_seed FROM agent_runs), j AS (SELECT DISTINCT task, config, model, seed FROM i WHERE rec_type = 'job_done' AND task IS NOT NULL AND config IS NOT NULL AND model IS NOT NULL AND seed IS NOT NULL), r AS (SELECT task, config, model, seed, count(*) AS n, count(DISTINCT (coalesce(role, ''), coalesce(replicate_seed, -1))) AS d FROM i WHERE rec_type = 'run' GROUP BY ALL) SELECT config, count(*) AS n_jobs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_runs, CAST(coalesce(sum(d), 0) AS BIGINT) AS n_identities FROM j LEFT JOIN r USING (task, config, model, seed) GROUP BY ALL")
def job_identities(spark, sf):
    """Distinct identities among the runs of finished jobs; fewer than runs where deliveries were repeated."""
    keys = ["task", "config", "model", "seed"]
    i = table(spark, sf, "agent_runs").select("rec_type", norm_key("task_id").alias("task"), norm_key("config").alias("config"), norm_key("model_id").alias("model"), norm_key("model_role").alias("role"), "seed", "replicate_seed")
    one = F.struct(F.coalesce("role", F.lit("")), F.coalesce("replicate_seed", F.lit(-1)))
    # distinct identities are folded first, so a job of very many deliveries is a row for each
    runs = i.where("rec_type = 'run'").groupBy(*keys, one.alias("id")).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    jobs = i.where("rec_type = 'job_done'").select(*keys).dropna().distinct().join(runs, keys, "left")
    return jobs.groupBy("config").agg(F.count(F.lit(1)).alias("n_jobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_runs"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_identities"))


_MAN = f"""{TIDY}, own AS (SELECT task, model, seed, min(uid) AS uid, count(*) AS n FROM tidy WHERE model_class = 'reasoning' AND method = 'single' GROUP BY ALL), e AS (SELECT t.task, m.model, s.seed FROM (SELECT task FROM task_facts WHERE regime IS NOT NULL AND ambiguity_k >= 1) t, (SELECT unnest(['dunmar/pith-2-think', 'quorra/glass-xl', 'sarvik/novel-r1']) AS model) m, (SELECT unnest({_ASKED}) AS seed) s)"""


def _manipulation(spark: SparkSession, sf: str):
    t = tidy(spark, sf).where("model_class = 'reasoning' AND method = 'single'")
    items = table(spark, sf, "tasks").where("regime IS NOT NULL AND ambiguity_level >= 1").select(norm_key("id").alias("task"))
    reasoners = ["dunmar/pith-2-think", "quorra/glass-xl", "sarvik/novel-r1"]
    grid = items.select("task", F.explode(F.array(*[F.lit(m) for m in reasoners])).alias("model")).select("task", "model", F.explode(F.array(*[F.lit(s).cast("bigint") for s in _ASKED])).alias("seed"), F.lit(1).alias("least"), F.lit(1).alias("most"))
    return t, grid


@book(f"{_MAN} SELECT CASE WHEN e.task IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status, count(*) AS n_cells FROM e FULL JOIN own ON e.task = own.task AND e.model = own.model AND e.seed = own.seed GROUP BY ALL")
def manipulation_grid(spark, sf):
    """Cells of the check of the manipulation: items by reasoning models by requested seeds, one answer each."""
    t, grid = _manipulation(spark, sf)
    cells_of = G.compare_grids(grid, t, ["task", "model", "seed"], most="most")
    return cells_of.select(F.when(F.col("status") == "overfilled", "duplicate").otherwise(F.col("status")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n_cells"))


@book(f"{_MAN}, f AS (SELECT t.* FROM tidy t JOIN own USING (uid) JOIN e ON e.task = own.task AND e.model = own.model AND e.seed = own.seed), r AS (SELECT task, regime, avg(CASE WHEN label = target THEN 1.0 ELSE 0.0 END) AS recovery FROM f GROUP BY ALL), m AS (SELECT avg(recovery) FILTER (regime = 'H2_derivable') AS h2, avg(recovery) FILTER (regime = 'H1_external') AS h1 FROM r) SELECT {r6('h2')} AS mean_h2, {r6('h1')} AS mean_h1, CASE WHEN h2 >= 0.6 AND h1 <= 0.4 AND h2 - h1 >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m")
def manipulation_check(spark, sf):
    """The gate over the first answer of each expected cell."""
    t, grid = _manipulation(spark, sf)
    keys = ["task", "model", "seed"]
    first = G.first_wins(t, keys, "uid").join(grid.select(*keys), keys, "left_semi")
    return S.recovery_gate(S.recovery(first))


@book(f"WITH k AS (SELECT {nk('task_id')} AS task, {nk('config')} AS config, {nk('model_role')} AS role, {nk('model_id')} AS model, seed, strftime(ingested_at, '%Y-%m') AS shard FROM agent_runs WHERE rec_type = 'run'), g AS (SELECT *, count(*) OVER (PARTITION BY task, config, role, model, seed) AS copies FROM k) SELECT shard, model, count(*) AS n_read, count(*) FILTER (copies > 1) AS n_repeated FROM g GROUP BY ALL")
def shard_counts(spark, sf):
    """Records read and repeated by shard (the month of delivery) and model."""
    keys = ["task", "config", "role", "model", "seed"]
    k = table(spark, sf, "agent_runs").where("rec_type = 'run'").select(norm_key("task_id").alias("task"), norm_key("config").alias("config"), norm_key("model_role").alias("role"), norm_key("model_id").alias("model"), "seed", F.date_format("ingested_at", "yyyy-MM").alias("shard"))
    per = k.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy(*keys).agg(F.sum("n").alias("copies"), F.collect_list(F.struct("shard", "n")).alias("s"))  # a shard once, so as many as there are months
    return whole.select("model", "copies", F.explode("s").alias("s")).groupBy("s.shard", "model").agg(F.sum("s.n").alias("n_read"), F.sum(F.when(F.col("copies") > 1, F.col("s.n")).otherwise(0)).alias("n_repeated"))


@book(f"""WITH x AS (SELECT {nk('id')} AS task, domain, ambiguity_level AS k, interpretations AS i FROM tasks), f AS (SELECT *, len(i) <> (1 << k) AS wrong_size, len(list_filter(i, lambda e: e.is_target)) <> 1 AS wrong_targets, len(list_distinct(list_transform(i, lambda e: e.id))) <> len(i) AS repeated_ids, len(list_filter(i, lambda e: e.gold_check IS NULL)) > 0 AS unchecked, len(list_distinct(list_filter(list_transform(i, lambda e: e.gold_check), lambda c: c IS NOT NULL))) < len(i) AS indistinct FROM x)
SELECT task, domain, array_to_string(list_filter([CASE WHEN wrong_size THEN 'size' END, CASE WHEN wrong_targets THEN 'targets' END, CASE WHEN repeated_ids THEN 'ids' END, CASE WHEN unchecked THEN 'unchecked' END, CASE WHEN indistinct THEN 'indistinct' END], lambda e: e IS NOT NULL), ',') AS failures FROM f WHERE wrong_size OR wrong_targets OR repeated_ids OR unchecked OR indistinct""")
def task_failures(spark, sf):
    """Tasks that a certification fails, with the reasons; without 'indistinct' a task's readings can be told apart."""
    i = F.col("interpretations")
    t = table(spark, sf, "tasks").select(norm_key("id").alias("task"), "domain", S.certification_failures(i, F.col("ambiguity_level")).alias("failures"))
    return t.where(F.size("failures") > 0).select("task", "domain", F.array_join("failures", ",").alias("failures"))


_PRICES = {"ostrel": 0.01, "quorra": 0.015, "dunmar": 0.03}


@book(f"SELECT {nk('model')} AS model, {r6('sum((coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) * CASE ' + ' '.join(f'WHEN starts_with({nk("model")}, {chr(39)}{k}/{chr(39)}) THEN {v}' for k, v in _PRICES.items()) + ' ELSE 0.002 END) / 1000')} AS estimate, {r6('sum(cost_usd)')} AS billed FROM completions GROUP BY ALL")
def estimated_costs(spark, sf):
    """Costs from tokens and a price of each family for a thousand of them, beside what was billed; other families have one price."""
    c = table(spark, sf, "completions").select(norm_key("model").alias("model"), (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"), "cost_usd")
    price = F.coalesce(F.create_map(*[x for k, v in _PRICES.items() for x in (F.lit(k), F.lit(v))])[F.substring_index("model", "/", 1)], F.lit(0.002))
    return c.groupBy("model").agg((F.sum(F.col("tokens") * price) / 1000).alias("estimate"), F.sum("cost_usd").alias("billed"))


@book(f"{CELLS}, m AS (SELECT regime, ambiguity_k, avg(cd_primary) AS mean FROM cells WHERE regime IS NOT NULL AND ambiguity_k IS NOT NULL GROUP BY ALL) SELECT regime, ambiguity_k, {r6('mean')} AS mean, false AS synthetic FROM m UNION ALL SELECT regime, 0, 0.0::DOUBLE, true FROM (SELECT DISTINCT regime FROM m) r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.regime = r.regime AND ambiguity_k = 0)")
def curve_from_zero(spark, sf):
    """Means by ambiguity level, with a point at 0 where a regime has none."""
    own = cells(tidy(spark, sf)).where("regime IS NOT NULL AND ambiguity_k IS NOT NULL")
    return C.with_zero(C.mean_by(own, ["regime", "ambiguity_k"], count=None), "regime", "ambiguity_k", "cd_primary").withColumnRenamed("cd_primary", "mean")


@book(f"{CELLS}, i AS (SELECT task, CASE WHEN ambiguity_k = 1 THEN 'k1' WHEN ambiguity_k > 1 THEN 'k2+' ELSE 'k0' END AS stratum, avg(cd_primary) AS cd FROM cells WHERE regime = 'H1_external' AND ambiguity_k IS NOT NULL GROUP BY ALL), h AS (SELECT median(cd) AS m FROM (SELECT task, avg(cd_primary) AS cd FROM cells WHERE regime = 'H2_derivable' GROUP BY ALL)) SELECT stratum, count(*) AS n_items, {r6('avg(cd)')} AS mean, {r6('median(cd)')} AS median, count(*) FILTER (cd <= (SELECT m FROM h)) AS n_convergent FROM i GROUP BY ALL")
def strata(spark, sf):
    """Items of external tasks by level: mean, median, and how many lie no higher than the median of derivable ones."""
    own = cells(tidy(spark, sf)).where("ambiguity_k IS NOT NULL OR regime = 'H2_derivable'")
    stratum = F.when(F.col("ambiguity_k") == 1, "k1").when(F.col("ambiguity_k") > 1, "k2+").otherwise("k0")
    items = cut(own.groupBy("task", "regime", stratum.alias("stratum")).agg(F.avg("cd_primary").alias("cd")))
    h2 = percentiles(items.where("regime = 'H2_derivable'").groupBy("task").agg(F.avg("cd").alias("cd")), [], "cd", {"m": 0.5})
    h1 = items.where("regime = 'H1_external'")
    n = h1.join(F.broadcast(h2)).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_items"), F.avg("cd").alias("mean"), F.count_if(F.col("cd") <= F.col("m")).alias("n_convergent"))
    return n.join(percentiles(h1, ["stratum"], "cd", {"median": 0.5}), "stratum")


QUERIES, SQL = book.queries, book.sql
