"""Queries on consensus: cells, contrasts, dependence, resampling and verdicts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.functions.keys import norm_key
from consensio.operators import contrasts as C
from consensio.operators import decide as V
from consensio.operators import dependence as D
from consensio.operators import linear as L
from consensio.operators import nulls as N
from consensio.operators import resample as R
from consensio.operators import verdicts as S
from consensio.operators.durable import cut
from consensio.operators.labels import CELL, MEASURES, cell_measures, cells, label_counts, modal_wrong
from consensio.operators.order import null_safe_join, percentiles
from consensio.operators.studies import family_verdicts
from consensio.plans.base import CELL_KEYS, CELLS, LABELS, TIDY, Book, measures_sql, r6, weight_sql
from consensio.sources.runs import tidy
from consensio.sources.tables import table

book = Book()
_M = ["cd_frozen", "cd_primary", "cd_drop_iperp", "iperp_rate", "entropy", "entropy_norm", "consistency", "minority", "divergence"]
#: Seed of the queries below, and replicates as in the reference: means of items, verdicts and the independent counterfactual, permutations of the gates.
SEED, B_ITEMS, B_VERDICT, B_NULL = 42, 2000, 500, 200


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells(tidy(spark, sf))


@book(f"{CELLS} SELECT {CELL_KEYS}, CAST(n_agents AS BIGINT) AS n_agents, a_maj, {r6('pairwise_wrong')} AS pairwise_wrong, {', '.join(f'{r6(m)} AS {m}' for m in _M)} FROM cells")
def cell_cd(spark, sf):
    return _cells(spark, sf).select(*CELL, "n_agents", "a_maj", "pairwise_wrong", *_M)


@book(f"{LABELS}, own AS (SELECT {CELL_KEYS}, 1 - sum(n * n) * 1.0 / (sum(n) * sum(n)) AS gini, count(*) AS n_labels FROM lc GROUP BY ALL) SELECT method, {r6('avg(gini)')} AS gini, {r6('avg(n_labels)')} AS n_labels FROM own GROUP BY ALL")
def own_measures(spark, sf):
    """Measures that a user adds to those of cells: the Gini index of the labels, and how many there are."""
    n = F.col("n")
    extra = {"gini": 1 - F.sum(n * n) / (F.sum(n) * F.sum(n)), "n_labels": F.count("label")}
    return C.mean_by(cells(tidy(spark, sf), CELL, extra), ["method"], ["gini", "n_labels"], None)


@book(f"{CELLS} SELECT regime, model_class, {r6('avg(cd_primary)')} AS cd_primary, count(*) AS n_cells FROM cells GROUP BY ALL")
def cd_by_regime(spark, sf):
    return C.mean_by(_cells(spark, sf), ["regime", "model_class"])


@book(f"{CELLS} SELECT model_class, method, ambiguity_k, {r6('avg(cd_primary)')} AS cd_primary, count(*) AS n_cells FROM cells GROUP BY ALL")
def cd_vs_k(spark, sf):
    return C.mean_by(_cells(spark, sf), ["model_class", "method", "ambiguity_k"]).orderBy("model_class", "method", "ambiguity_k")


@book(f"{CELLS} SELECT method, ambiguity_k, regime, {', '.join(f'{r6(f'avg({m})')} AS {m}' for m in MEASURES)}, count(*) AS n_cells FROM cells GROUP BY ALL")
def phase_diagram(spark, sf):
    return C.mean_by(_cells(spark, sf), ["method", "ambiguity_k", "regime"], MEASURES)


@book(f"{CELLS} SELECT method, {', '.join(f'{r6(f'avg(cd_primary) FILTER (ambiguity_k = {k})')} AS k{k}' for k in range(4))} FROM cells GROUP BY ALL")
def heatmap_method_k(spark, sf):
    levels = [r[0] for r in table(spark, sf, "tasks").select("ambiguity_level").dropna().distinct().orderBy("ambiguity_level").collect()]  # levels of a benchmark, a few
    return C.heatmap(_cells(spark, sf), "method", "ambiguity_k", levels)


@book(f"{CELLS} SELECT regime, method, model_class, {r6('avg(iperp_rate)')} AS iperp_rate, count(*) AS n_cells FROM cells GROUP BY ALL")
def iperp_rates(spark, sf):
    return C.mean_by(_cells(spark, sf), ["regime", "method", "model_class"], ["iperp_rate"])


@book(f"{CELLS} SELECT regime, ambiguity_k, {r6('avg(cd_primary)')} AS mean, {r6('stddev_samp(cd_primary) / sqrt(count(cd_primary))')} AS se, count(cd_primary) AS n FROM cells GROUP BY ALL")
def mean_and_error_by_k(spark, sf):
    return C.mean_and_error(_cells(spark, sf), ["regime", "ambiguity_k"])


@book(f"{CELLS}, m AS (SELECT method, {', '.join(f'avg({m}) AS {m}' for m in MEASURES)}, count(*) AS n_cells FROM cells WHERE regime = 'H1_external' GROUP BY ALL) SELECT a.method, a.n_cells, {', '.join(f'{r6(f'a.{m}')} AS {m}, {r6(f'a.{m} - s.{m}')} AS {m}_delta' for m in MEASURES)} FROM m a, m s WHERE s.method = 'single' AND a.method <> 'single'")
def agg_vs_single(spark, sf):
    return C.against_single(_cells(spark, sf))


def _ab(m: str, p: str) -> str:
    return f"avg({m}) FILTER (starts_with(method, '{p}'))"


@book(f"{CELLS} SELECT {', '.join(f'{r6(_ab(m, 'heterogeneous'))} AS {m}_a, {r6(_ab(m, 'homogeneous'))} AS {m}_b, {r6(f'{_ab(m, 'heterogeneous')} - {_ab(m, 'homogeneous')}')} AS {m}_delta' for m in MEASURES)} FROM cells")
def hetero_vs_homog(spark, sf):
    return C.method_contrast(_cells(spark, sf), "heterogeneous", "homogeneous")


@book(f"{CELLS} SELECT task, regime, {r6('avg(cd_primary)')} AS cd_primary, count(*) AS n_cells FROM cells WHERE ambiguity_k >= 1 GROUP BY ALL")
def per_item_cd(spark, sf):
    return C.mean_by(_cells(spark, sf).where("ambiguity_k >= 1"), ["task", "regime"])


_PAIRED = f"{CELLS}, p AS (SELECT task, avg(cd_primary) FILTER (method = 'heterogeneous-mad') AS mean_a, avg(cd_primary) FILTER (method = 'homogeneous-mad') AS mean_b FROM cells GROUP BY ALL)"


@book(f"{_PAIRED} SELECT task, {r6('mean_a')} AS mean_a, {r6('mean_b')} AS mean_b, {r6('mean_a - mean_b')} AS delta FROM p WHERE mean_a IS NOT NULL AND mean_b IS NOT NULL")
def paired_delta(spark, sf):
    return C.paired_delta(_cells(spark, sf), "heterogeneous-mad", "homogeneous-mad")


@book(f"{CELLS} SELECT method, regime, {r6('avg(a_maj)')} AS a_maj, count(*) AS n_cells FROM cells GROUP BY ALL")
def a_maj(spark, sf):
    return C.mean_by(_cells(spark, sf), ["method", "regime"], ["a_maj"])


@book(f"{CELLS} SELECT regime, method, {r6('avg(pairwise_wrong)')} AS pairwise_wrong, count(pairwise_wrong) AS n_defined FROM cells GROUP BY ALL")
def pairwise_agreement(spark, sf):
    return _cells(spark, sf).groupBy("regime", "method").agg(F.avg("pairwise_wrong").alias("pairwise_wrong"), F.count("pairwise_wrong").alias("n_defined"))


_KEY = "method IS NOT DISTINCT FROM {0}.method AND model_class IS NOT DISTINCT FROM {0}.model_class AND seed = {0}.seed"


@book(f"""{LABELS}, own AS (SELECT * FROM lc WHERE label <> 'I_perp'), per AS (SELECT {CELL_KEYS}, sum(n) AS m, sum(n * (n - 1)) AS pairs FROM own GROUP BY ALL HAVING sum(n) >= 2),
po AS (SELECT method, model_class, seed, avg(pairs * 1.0 / (m * (m - 1))) AS p_o, count(*) AS subjects, sum(m) AS ratings FROM per GROUP BY ALL),
sh AS (SELECT method, model_class, seed, sum(n * n) AS squares FROM (SELECT o.method, o.model_class, o.seed, o.label, sum(o.n) AS n FROM own o SEMI JOIN per p ON p.task = o.task AND p.method IS NOT DISTINCT FROM o.method AND p.model_class = o.model_class AND p.seed = o.seed GROUP BY ALL) GROUP BY ALL),
cats AS (SELECT c.method, c.model_class, c.seed, count(DISTINCT i.label) AS categories FROM (SELECT DISTINCT task, method, model_class, seed FROM lc) c JOIN (SELECT DISTINCT task, label FROM own) i USING (task) GROUP BY ALL),
k AS (SELECT po.*, squares * 1.0 / (ratings * ratings) AS p_e, categories FROM po JOIN sh ON po.method IS NOT DISTINCT FROM sh.method AND po.model_class = sh.model_class AND po.seed = sh.seed JOIN cats ON po.method IS NOT DISTINCT FROM cats.method AND po.model_class = cats.model_class AND po.seed = cats.seed)
SELECT method, model_class, seed, subjects, {r6('CASE WHEN subjects >= 2 AND categories >= 2 THEN CASE WHEN abs(1 - p_e) < 1e-12 THEN CASE WHEN abs(p_o - 1) < 1e-12 THEN 1.0 END ELSE (p_o - p_e) / nullif(1 - p_e, 0) END END')} AS kappa FROM k""")
def fleiss_kappa(spark, sf):
    return D.fleiss_kappa(label_counts(tidy(spark, sf)), ["method", "model_class", "seed"], ["task", "regime", "ambiguity_k"])


_ICC = f"""{CELLS}, w AS (SELECT regime, n_agents, n_agents - n_target AS n_wrong FROM cells WHERE regime IS NOT NULL),
g AS (SELECT regime, count(*) AS k, sum(n_agents) AS nn, sum(n_wrong) AS s, sum(n_wrong * n_wrong * 1.0 / n_agents) AS q, sum(1.0 / n_agents) AS inv FROM w GROUP BY ALL),
m AS (SELECT *, (q - s * s * 1.0 / nn) / nullif(k - 1, 0) AS msb, (s - q) / nullif(nn - k, 0) AS msw, k / inv AS n0, nn * 1.0 / k AS mean_agents FROM g),
i AS (SELECT *, CASE WHEN k >= 2 THEN (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) END AS icc, round_even(nn * 1.0 / k, 0) AS r FROM m)"""


@book(f"{_ICC} SELECT regime, k AS n_cells, {r6('icc')} AS icc, {r6('mean_agents')} AS mean_agents, {r6('CASE WHEN icc IS NULL THEN NULL WHEN r <= 1 OR 1 + (r - 1) * icc <= 0 THEN r ELSE r / (1 + (r - 1) * icc) END')} AS n_eff FROM i")
def icc_neff(spark, sf):
    own = _cells(spark, sf).where("regime IS NOT NULL").withColumn("n_wrong", F.col("n_agents") - F.col("n_target"))
    return D.icc(own, ["regime"]).withColumn("n_eff", D.effective_size(F.bround("mean_agents", 0), F.col("icc")))


@book(f"""{TIDY}, e AS (SELECT task, model, avg(CASE WHEN label <> target THEN 1.0 ELSE 0.0 END) AS e FROM tidy WHERE model IS NOT NULL GROUP BY ALL),
s AS (SELECT count(*) * 1.0 AS n, sum(a.e) AS x, sum(b.e) AS y, sum(a.e * a.e) AS xx, sum(b.e * b.e) AS yy, sum(a.e * b.e) AS xy FROM e a JOIN e b ON a.task = b.task AND a.model < b.model GROUP BY a.model, b.model),
r AS (SELECT CASE WHEN n * xx - x * x > 0 AND n * yy - y * y > 0 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS r FROM s)
SELECT {r6('coalesce(avg(r), 0)')} AS rho, count(r) AS n_pairs FROM r""")
def marginal_rho(spark, sf):
    t = tidy(spark, sf).where("model IS NOT NULL").withColumn("error", (F.col("label") != F.col("target")).cast("double"))
    return D.marginal_rho(t, "model", "task", "error")


@book(f"{LABELS}, w AS (SELECT task, label, sum(n) AS n FROM lc WHERE label <> target AND label <> 'I_perp' GROUP BY ALL) SELECT task, arg_min(label, (-n, label)) AS foil, CAST(max(n) AS BIGINT) AS n_foil FROM w GROUP BY ALL")
def modal_foil(spark, sf):
    return modal_wrong(label_counts(tidy(spark, sf)), ["task"])


@book(f"""{TIDY}, c AS (SELECT task, target, label, count(*) AS n FROM tidy GROUP BY ALL), m AS ({measures_sql('c', 'task')}),
f AS (SELECT task, arg_min(label, (-n, label)) AS foil FROM c WHERE label <> target AND label <> 'I_perp' GROUP BY ALL)
SELECT m.task, {r6('cd_primary')} AS cd_primary, foil, coalesce(n_models, 0) AS n_models, coalesce(n_families, 0) AS n_families FROM m LEFT JOIN f USING (task)
LEFT JOIN (SELECT t.task, count(DISTINCT model) AS n_models, count(DISTINCT family) AS n_families FROM tidy t JOIN f ON t.task = f.task AND t.label = f.foil GROUP BY ALL) x ON x.task = m.task""")
def cross_model_concentration(spark, sf):
    t = tidy(spark, sf)
    counts = label_counts(t, ["task", "model", "family"])
    whole = counts.groupBy("task", "target", "label").agg(F.sum("n").alias("n"))
    foil = modal_wrong(whole, ["task"]).select("task", "foil")
    on = counts.join(foil, "task").where(F.col("label") == F.col("foil")).groupBy("task").agg(F.countDistinct("model").alias("n_models"), F.countDistinct("family").alias("n_families"))
    return cell_measures(whole, ["task"]).select("task", "cd_primary").join(foil, "task", "left").join(on, "task", "left").fillna(0, ["n_models", "n_families"])


@book(f"{CELLS} SELECT ambiguity_k, model_class, {', '.join(f'{r6(f'avg({m})')} AS {m}' for m in ('entropy', 'entropy_norm', 'divergence', 'minority', 'consistency'))}, count(*) AS n_cells FROM cells GROUP BY ALL")
def semantic_entropy(spark, sf):
    return C.mean_by(_cells(spark, sf), ["ambiguity_k", "model_class"], ["entropy", "entropy_norm", "divergence", "minority", "consistency"])


_POOLED = f"{TIDY}, two AS (SELECT task, method, seed, regime, ambiguity_k, target, label, unnest([model, 'POOLED']) AS model FROM tidy WHERE model IS NOT NULL), c AS (SELECT task, model, target, label, count(*) AS n FROM two GROUP BY ALL), m AS ({measures_sql('c', 'task, model')})"


@book(f"{_POOLED} SELECT model, {r6('avg(cd_primary)')} AS cd_primary, {r6('avg(entropy)')} AS entropy, count(*) AS n_cells FROM m GROUP BY ALL")
def pooled_groups(spark, sf):
    t = C.with_pooled(tidy(spark, sf).where("model IS NOT NULL"), "model")
    return C.mean_by(cells(t, ["task", "model"]), ["model"], ["cd_primary", "entropy"])


@book(f"{CELLS}, i AS (SELECT domain, regime, t.task, avg(cd_primary) AS cd FROM cells JOIN task_facts t USING (task, regime) GROUP BY ALL) SELECT domain, {r6("avg(cd) FILTER (regime = 'H1_external')")} AS h1, {r6("avg(cd) FILTER (regime = 'H2_derivable')")} AS h2, {r6("avg(cd) FILTER (regime = 'H1_external') - avg(cd) FILTER (regime = 'H2_derivable')")} AS delta, count(*) AS n_items FROM i GROUP BY ALL")
def regime_by_domain(spark, sf):
    t = tidy(spark, sf).where("regime IS NOT NULL")
    item = cells(t, [*CELL, "domain"]).groupBy("domain", "regime", "task").agg(F.avg("cd_primary").alias("cd"))
    h1, h2 = (F.avg(F.when(F.col("regime") == r, F.col("cd"))) for r in ("H1_external", "H2_derivable"))
    return item.groupBy("domain").agg(h1.alias("h1"), h2.alias("h2"), (h1 - h2).alias("delta"), F.count(F.lit(1)).alias("n_items"))


@book(f"{TIDY} SELECT constructor_family, count(*) AS n_rows, count(*) FILTER (family = constructor_family) AS n_held_out, {r6("avg(CASE WHEN label <> target THEN 1.0 ELSE 0.0 END) FILTER (family <> constructor_family)")} AS error_rate FROM tidy GROUP BY ALL")
def provenance_holdout(spark, sf):
    own = F.col("family") == F.col("constructor_family")
    return tidy(spark, sf).groupBy("constructor_family").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(own).alias("n_held_out"), F.avg(F.when(~own, (F.col("label") != F.col("target")).cast("double"))).alias("error_rate"))


@book(f"""{TIDY}, c AS (SELECT task, model, target, label, count(*) AS n FROM tidy WHERE model_class = 'reasoning' AND ambiguity_k = 1 GROUP BY ALL), m AS ({measures_sql('c', 'task, model')}),
s AS (SELECT split_part(task, '_k', 1) AS family, avg(n_target * 1.0 / n_agents) AS resolve_rate, avg(cd_primary) AS cd_primary, avg(iperp_rate) AS iperp_rate, count(*) AS n_rows FROM m GROUP BY ALL),
f AS (SELECT DISTINCT split_part(task, '_k', 1) AS family FROM task_facts WHERE ambiguity_k = 1 AND task IS NOT NULL)
SELECT f.family, coalesce(n_rows, 0) AS n_rows, {r6('resolve_rate')} AS resolve_rate, {r6('cd_primary')} AS cd_primary, {r6('iperp_rate')} AS iperp_rate, CASE WHEN n_rows IS NULL THEN 'INSUFFICIENT-DATA' WHEN resolve_rate >= 0.5 AND cd_primary <= 0.5 THEN 'RESOLVES' ELSE 'MIS-TAGGED' END AS verdict FROM f LEFT JOIN s USING (family)""")
def family_screen(spark, sf):
    """Whether reasoning models resolve the k1 tasks of a family, and do not agree on a wrong reading, by means over tasks and models."""
    own = cells(tidy(spark, sf).where("model_class = 'reasoning' AND ambiguity_k = 1"), ["task", "model"])
    families = table(spark, sf, "tasks").where("ambiguity_level = 1").select(norm_key("id").alias("task")).dropna()
    return family_verdicts(own, families)


@book(f"{CELLS} SELECT method, CASE WHEN regime = 'H1_external' AND ambiguity_k >= 1 THEN 'H1_k1' WHEN regime = 'H1_external' THEN 'H1_k0' WHEN regime = 'H2_derivable' THEN 'H2' ELSE 'other' END AS category, {r6('avg(cd_primary)')} AS cd_primary, {r6('median(cd_primary)')} AS cd_median, count(*) AS n_cells FROM cells GROUP BY ALL")
def pilot_summary(spark, sf):
    category = F.when((F.col("regime") == "H1_external") & (F.col("ambiguity_k") >= 1), "H1_k1").when(F.col("regime") == "H1_external", "H1_k0").when(F.col("regime") == "H2_derivable", "H2").otherwise("other")
    own = cut(_cells(spark, sf).select("method", category.alias("category"), "cd_primary"))
    means = own.groupBy("method", "category").agg(F.avg("cd_primary").alias("cd_primary"), F.count(F.lit(1)).alias("n_cells"))
    return null_safe_join(means, percentiles(own, ["method", "category"], "cd_primary", {"cd_median": 0.5}), ["method", "category"])


# resampling

_ITEMS = f"{CELLS}, b AS (SELECT unnest(range({B_ITEMS})) AS b), items AS (SELECT task, regime, avg(cd_primary) AS v FROM cells GROUP BY ALL)"


def _index(values: str) -> tuple[str, str]:
    s = f"list_sort(list({values}))"
    return f"({s})[greatest(0, CAST(floor(count(*) * 0.025) AS INT) - 1) + 1]", f"({s})[least(count(*) - 1, CAST(floor(count(*) * 0.975) AS INT)) + 1]"


_LO, _HI = _index("mean")


@book(f"{_ITEMS}, own AS (SELECT * FROM items WHERE regime = 'H1_external'), m AS (SELECT b, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT b, v, {weight_sql(SEED, 'b', 'task')} AS w FROM own, b) GROUP BY ALL) SELECT {r6('(SELECT avg(v) FROM own)')} AS point, {r6(_LO)} AS lo, {r6(_HI)} AS hi FROM m")
def boot_mean_ci(spark, sf):
    items = _cells(spark, sf).where("regime = 'H1_external'").groupBy("task").agg(F.avg("cd_primary").alias("v"))
    return R.mean_ci(items, "task", "v", B_ITEMS, SEED)


_DIFF = "max(mean) FILTER (regime = 'H1_external') - max(mean) FILTER (regime = 'H2_derivable')"


@book(f"""{_ITEMS}, own AS (SELECT * FROM items WHERE regime IN ('H1_external', 'H2_derivable')), m AS (SELECT b, regime, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT b, regime, v, {weight_sql(SEED, 'b', "regime || '|' || task")} AS w FROM own, b) GROUP BY ALL),
d AS (SELECT b, {_DIFF} AS mean FROM m GROUP BY ALL), p AS (SELECT {_DIFF} AS point FROM (SELECT regime, avg(v) AS mean FROM own GROUP BY ALL)) SELECT {r6('(SELECT point FROM p)')} AS point, {r6(_LO)} AS lo, {r6(_HI)} AS hi FROM d WHERE mean IS NOT NULL""")
def boot_diff_ci(spark, sf):
    items = _cells(spark, sf).groupBy("task", "regime").agg(F.avg("cd_primary").alias("v"))
    return R.signed_ci(items, "task", "v", "regime", {"H1_external": 1, "H2_derivable": -1}, B_ITEMS, SEED)


_DOMAINS = ["code_spec", "data_analysis", "policy_qa", "r2_xf"]
_PAIRS = [(x, y) for i, x in enumerate(_DOMAINS) for y in _DOMAINS[i + 1 :]]


def _four(x: str, y: str) -> dict[str, int]:
    return {f"{x}/H1_external": 1, f"{x}/H2_derivable": -1, f"{y}/H1_external": -1, f"{y}/H2_derivable": 1}


def _signed(x: str, y: str) -> str:
    return " + ".join(f"({s}) * max(mean) FILTER (g = '{g}')" for g, s in _four(x, y).items())


@book(f"""{CELLS}, b AS (SELECT unnest(range({B_ITEMS})) AS b), own AS (SELECT f.domain || '/' || c.regime AS g, c.task, avg(cd_primary) AS v FROM cells c JOIN task_facts f ON f.task = c.task WHERE c.regime IS NOT NULL GROUP BY ALL),
m AS (SELECT b, g, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT b, g, v, {weight_sql(SEED, 'b', "g || '|' || task")} AS w FROM own, b) GROUP BY ALL), p AS (SELECT g, avg(v) AS mean FROM own GROUP BY ALL)
{' UNION ALL '.join(f"SELECT '{x}' AS domain, '{y}' AS other, {r6(f'(SELECT {_signed(x, y)} FROM p)')} AS point, {r6(_LO)} AS lo, {r6(_HI)} AS hi FROM (SELECT b, {_signed(x, y)} AS mean FROM m GROUP BY ALL) WHERE mean IS NOT NULL" for x, y in _PAIRS)}""")
def boot_interaction_ci(spark, sf):
    """Interaction of regime and domain, for every two domains."""
    items = cells(tidy(spark, sf).where("regime IS NOT NULL"), [*CELL, "domain"]).groupBy(F.concat_ws("/", "domain", "regime").alias("g"), "task").agg(F.avg("cd_primary").alias("v"))
    items = cut(items)
    out = None
    for x, y in _PAIRS:
        one = R.signed_ci(items, "task", "v", "g", _four(x, y), B_ITEMS, SEED).select(F.lit(x).alias("domain"), F.lit(y).alias("other"), "point", "lo", "hi")
        out = one if out is None else out.unionByName(one)
    return out


def _clustered(two_way: bool) -> str:
    models = f"SELECT b, model, {weight_sql(SEED + 1, 'b', 'model')} AS mw FROM (SELECT DISTINCT model FROM mc), b" if two_way else "SELECT b, model, 1 AS mw FROM (SELECT DISTINCT model FROM mc), b"
    return f"""{TIDY}, b AS (SELECT unnest(range({B_VERDICT})) AS b), mc AS (SELECT {CELL_KEYS}, model, target, label, count(*) AS n FROM tidy WHERE regime = 'H1_external' AND model IS NOT NULL GROUP BY ALL),
tw AS (SELECT b, task, {weight_sql(SEED, 'b', 'task')} AS tw FROM (SELECT DISTINCT task FROM mc), b), mw AS ({models}),
wc AS (SELECT mc.* EXCLUDE (model, n), tw.b, max(tw) AS weight, sum(n * mw) AS n FROM mc JOIN (SELECT * FROM mw WHERE mw > 0) mw USING (model) JOIN (SELECT * FROM tw WHERE tw > 0) tw ON tw.task = mc.task AND tw.b = mw.b GROUP BY ALL),
cm AS ({measures_sql('wc', f'b, weight, {CELL_KEYS}')}),
s AS (SELECT b, sum(weight * cd_primary) FILTER (method <> 'single') / sum(weight) FILTER (method <> 'single') - sum(weight * cd_primary) FILTER (method = 'single') / sum(weight) FILTER (method = 'single') AS d FROM cm GROUP BY ALL)
SELECT {r6('quantile_cont(d, 0.025)')} AS lo, {r6('quantile_cont(d, 0.975)')} AS hi, CASE WHEN quantile_cont(d, 0.025) >= 0 THEN 'SUPPORTED' WHEN quantile_cont(d, 0.975) < 0 THEN 'REFUTED' ELSE 'INCONCLUSIVE' END AS verdict FROM s"""


def _h1a(spark, sf, how: str) -> DataFrame:
    t = tidy(spark, sf).where("regime = 'H1_external' AND model IS NOT NULL AND method IS NOT NULL")
    reps = S.against_single_replicates(label_counts(t, [*CELL, "model"]), CELL, B_VERDICT, SEED, how)
    return R.percentile_ci(reps, "d").withColumn("verdict", V.verdict(F.col("lo"), F.col("hi"), at_least_zero=True))


@book(_clustered(True))
def cluster_boot_h1a(spark, sf):
    """Aggregation against single answers, tasks and models weighted independently."""
    return _h1a(spark, sf, "two-way")


@book(_clustered(False))
def task_boot_h1a(spark, sf):
    """The same with tasks alone as clusters."""
    return _h1a(spark, sf, "task")


@book()
def agent_boot_h1a(spark, sf):
    """The same with agents drawn by themselves."""
    return _h1a(spark, sf, "agent")


_COND = ["regime", "method", "model", "ambiguity_k"]


def _complete(spark, sf) -> DataFrame:
    return tidy(spark, sf).where("regime IS NOT NULL AND model IS NOT NULL AND method IS NOT NULL")


def _shuffled(spark, sf, measure: str) -> DataFrame:
    keys = ["task", *_COND]
    counts = cut(label_counts(_complete(spark, sf), keys))  # read for cells, pools and sizes
    return N.gap(counts, keys, N.shuffled(counts, keys, _COND, ["regime"], B_NULL, SEED, measure), ["regime"], measure)


@book()
def shuffle_null(spark, sf):
    """Agreement beyond labels shuffled among the items of a condition, conditions weighted by their items."""
    return _shuffled(spark, sf, "cd_primary")


@book()
def shuffle_null_frozen(spark, sf):
    """The same where I_perp may be the label agreed on."""
    return _shuffled(spark, sf, "cd_frozen")


@book()
def uniform_null(spark, sf):
    """Agreement beyond agents that take an interpretation at random."""
    keys = [*CELL, "n_interpretations"]
    counts = cut(label_counts(_complete(spark, sf), keys))  # read for cells, pools and sizes
    return N.gap(counts, keys, N.uniform(counts, keys, "n_interpretations", ["ambiguity_k"], B_NULL, SEED), ["ambiguity_k"])


@book()
def indep_counterfactual(spark, sf):
    """Agreement beyond agents that draw independently from their models' labels, with its interval."""
    t = tidy(spark, sf)
    counts = cut(label_counts(_complete(spark, sf), [*CELL, "model"]))
    pool = t.where("model IS NOT NULL").groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))
    return N.gap(counts, CELL, N.redrawn(counts, CELL, pool, ["regime"], "model", B_VERDICT, SEED), ["regime"])


def _sign_sql(m: str) -> str:
    return f"(SELECT avg({m}) FILTER (method <> 'single') - avg({m}) FILTER (method = 'single') FROM cells WHERE regime = 'H1_external')"


@book(f"{CELLS}, s AS (SELECT list_distinct([CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' WHEN x = 0 THEN '0' END FOR x IN [{', '.join(_sign_sql(m) for m in MEASURES[:3])}]]) AS d) SELECT CASE WHEN len(d) = 0 THEN 'indeterminate' WHEN len(d) = 1 THEN 'robust:' || d[1] ELSE 'divergent' END AS h1a FROM s")
def robustness(spark, sf):
    own = _cells(spark, sf).where("regime = 'H1_external'")
    single = F.col("method") == "single"
    points = own.agg(*[(F.avg(F.when(~single, F.col(m))) - F.avg(F.when(single, F.col(m)))).alias(m) for m in MEASURES[:3]])
    return points.select(V.robustness([F.col(m) for m in MEASURES[:3]]).alias("h1a"))


@book()
def tost_paired(spark, sf):
    """Equivalence of the two debates; the test itself is on the driver, from three folded numbers."""
    d = C.paired_delta(_cells(spark, sf), "heterogeneous-mad", "homogeneous-mad").agg(F.count("delta").alias("n"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("s")).first()
    t = V.tost(d["n"], d["m"] or 0.0, d["s"] or 0.0, 0.1)
    return spark.createDataFrame([(d["n"], d["m"], t["lo"], t["hi"], t["p"], t["equivalent"])], "n bigint, mean double, lo double, hi double, p double, equivalent boolean")


@book()
def k_coefficient(spark, sf):
    """Slope of concentration on ambiguity over tasks and methods, with a random intercept for each task or else errors clustered by task."""
    rows = cut(C.mean_by(_cells(spark, sf).where("regime = 'H1_external'"), ["task", "method", "ambiguity_k"]))
    d, names = L.design(rows, ["ambiguity_k"])
    df = spark.createDataFrame([L.interval(L.fit(d, "cd_primary", names, "task"), "ambiguity_k")], "point double, lo double, hi double, status string")
    return df.withColumn("verdict", V.verdict(F.col("lo"), F.col("hi")))


@book()
def verdicts(spark, sf):
    """All verdicts of the study from the tidy table."""
    return S.evaluate(tidy(spark, sf), b=B_VERDICT, n_perm=B_NULL)


@book()
def gate(spark, sf):
    """The checks that a pilot must pass."""
    return S.pilot_gate(tidy(spark, sf), b=B_ITEMS, n_perm=B_NULL)


QUERIES, SQL = book.queries, book.sql
