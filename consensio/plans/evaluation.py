"""Queries on the detector, on scores against truth, and on texts of answers."""

from pyspark.sql import functions as F

from consensio.functions import text as X
from consensio.functions.keys import norm_key
from consensio.functions.keys import sql_norm_key as nk
from consensio.operators import evaluation as E
from consensio.operators.dependence import pearson
from consensio.operators.detector import baseline_scores, cluster_entropy, context_entropy, danger, surfacing
from consensio.operators.labels import cells, ratio
from consensio.operators.resample import auroc_ci
from consensio.operators.studies import gold_stratum, recovery, recovery_gate
from consensio.plans.base import CELLS, TIDY, Book, measures_sql, r6, weight_sql
from consensio.sources.runs import tidy
from consensio.sources.tables import table

book = Book()


def _sig(minority: str = "minority", divergence: str = "divergence") -> str:
    return f"CASE WHEN {minority} < 0.34 THEN 0.0 ELSE {divergence} END"


SURFACING = f"""{TIDY}, c3 AS (SELECT task, model, family, target, label, count(*) AS n FROM tidy GROUP BY ALL),
c1 AS (SELECT task, target, label, sum(n) AS n FROM c3 GROUP BY ALL), m1 AS ({measures_sql('c1', 'task')}),
c2 AS (SELECT task, model, target, label, sum(n) AS n FROM c3 WHERE model IS NOT NULL GROUP BY ALL), m2 AS ({measures_sql('c2', 'task, model')}),
inst AS (SELECT task, avg({_sig()}) AS s_inst FROM m2 WHERE n_enumerated >= 2 GROUP BY ALL),
fl AS (SELECT task, family, label, sum(n) AS n FROM c3 WHERE family IS NOT NULL AND label <> 'I_perp' GROUP BY ALL), fm AS (SELECT task, family, arg_min(label, (-n, label)) AS label FROM fl GROUP BY ALL),
c4 AS (SELECT task, '' AS target, label, count(*) AS n FROM fm GROUP BY ALL), m4 AS ({measures_sql('c4', 'task')}), crs AS (SELECT task, {_sig()} AS s_cross FROM m4 WHERE n_agents >= 2),
sig AS (SELECT m1.task, n_agents, k_enumerated, {_sig()} AS s_div, s_inst, s_cross FROM m1 LEFT JOIN inst USING (task) LEFT JOIN crs USING (task)),
surf AS (SELECT *, round(greatest(0, least(1, (0.5 * s_div + 0.25 * coalesce(s_inst, 0) + 0.25 * coalesce(s_cross, 0)) / (0.5 + CASE WHEN s_inst IS NULL THEN 0 ELSE 0.25 END + CASE WHEN s_cross IS NULL THEN 0 ELSE 0.25 END))), 9) AS score FROM sig),
items AS (SELECT s.*, score >= 0.3 AS fired, t.regime, t.ambiguity_k, t.ambiguity_k >= 1 AS positive, t.ambiguity_k = 0 AS control, t.key_questions FROM surf s JOIN task_facts t USING (task))"""


def _items(spark, sf):
    facts = table(spark, sf, "tasks").select(norm_key("id").alias("task"), "regime", F.col("ambiguity_level").alias("ambiguity_k"), (F.col("ambiguity_level") >= 1).alias("positive"), (F.col("ambiguity_level") == 0).alias("control"), "key_questions")
    own = surfacing(tidy(spark, sf), facts)
    return own.join(facts.drop("key_questions"), "task")


@book(f"{SURFACING} SELECT task, n_agents, {', '.join(f'{r6(c)} AS {c}' for c in ('s_div', 's_inst', 's_cross', 'score'))}, fired, CASE WHEN fired AND (k_enumerated >= 2 OR coalesce(s_inst > 0, false) OR coalesce(s_cross > 0, false)) THEN len(coalesce(key_questions, [])) ELSE 0 END AS n_axes FROM items")
def surfacing_score(spark, sf):
    return _items(spark, sf).select("task", "n_agents", "s_div", "s_inst", "s_cross", "score", "fired", F.size("axes").alias("n_axes"))


@book(f"{SURFACING} SELECT regime, ambiguity_k, count(*) AS n, {r6('avg(CASE WHEN fired THEN 1.0 ELSE 0.0 END)')} AS fire_rate, {r6('avg(score)')} AS mean_score FROM items GROUP BY ALL")
def detector_by_k(spark, sf):
    return _items(spark, sf).groupBy("regime", "ambiguity_k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("fired").cast("double")).alias("fire_rate"), F.avg("score").alias("mean_score"))


_AUC = "CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(q) AS BIGINT) AS n_negative, {0} AS auroc".format(r6("sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0)"))


@book(f"{SURFACING}, per AS (SELECT regime, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM items WHERE positive IS NOT NULL GROUP BY ALL), w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY regime ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per) SELECT regime, {_AUC} FROM w GROUP BY ALL")
def detector_auroc(spark, sf):
    return E.auroc(_items(spark, sf), "score", "positive", ["regime"])


_PRF = f"""count(*) FILTER (fired AND positive) AS tp, count(*) FILTER (fired AND NOT positive) AS fp, count(*) FILTER (NOT fired AND positive) AS fn, count(*) FILTER (NOT fired AND NOT positive) AS tn"""


@book(f"""{SURFACING}, x AS (SELECT regime, {_PRF} FROM items GROUP BY ALL), y AS (SELECT *, tp * 1.0 / nullif(tp + fp, 0) AS p, tp * 1.0 / nullif(tp + fn, 0) AS r FROM x)
SELECT regime, tp, fp, fn, tn, {r6('p')} AS precision_or_null, {r6('r')} AS recall_or_null, {r6('coalesce(p, 0)')} AS precision, {r6('coalesce(r, 0)')} AS recall, {r6('coalesce(2 * coalesce(p, 0) * coalesce(r, 0) / nullif(coalesce(p, 0) + coalesce(r, 0), 0), 0)')} AS f1 FROM y""")
def detector_confusion(spark, sf):
    return E.confusion(_items(spark, sf), "fired", "positive", ["regime"])


@book(f"""{SURFACING}, cand AS (SELECT 0.0::DOUBLE AS t UNION SELECT 1.0::DOUBLE + 1e-9 UNION SELECT score FROM items UNION SELECT score + 1e-9 FROM items),
ev AS (SELECT t, (SELECT count(*) FROM items WHERE control AND score >= t) * 1.0 / nullif((SELECT count(*) FROM items WHERE control), 0) AS f, (SELECT count(*) FROM items WHERE positive AND score >= t) * 1.0 / nullif((SELECT count(*) FROM items WHERE positive), 0) AS r FROM cand WHERE t <= 1.0::DOUBLE + 1e-9)
SELECT {r6('t')} AS threshold, {r6('coalesce(r, 0)')} AS recall, {r6('coalesce(f, 0)')} AS false_rate FROM ev WHERE coalesce(f, 0) < 0.1 ORDER BY round(coalesce(r, 0), 12) DESC, t LIMIT 1""")
def threshold_select(spark, sf):
    return E.threshold(_items(spark, sf), "score", "control", "positive")


@book(f"""{SURFACING}, o AS (SELECT 'all' AS dim, '' AS value, * FROM items UNION ALL SELECT 'regime', regime, * FROM items UNION ALL SELECT 'ambiguity_k', CAST(ambiguity_k AS VARCHAR), * FROM items),
per AS (SELECT dim, value, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM o WHERE positive IS NOT NULL GROUP BY ALL), w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY dim, value ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
a AS (SELECT dim, value, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auroc FROM w GROUP BY ALL), x AS (SELECT dim, value, count(*) AS n, count(*) FILTER (control AND fired) * 1.0 / nullif(count(*) FILTER (control), 0) AS fr, {_PRF} FROM o GROUP BY ALL),
y AS (SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS p, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS r FROM x)
SELECT y.dim, y.value, n, {r6('fr')} AS false_rate, {r6('auroc')} AS auroc, {r6('p')} AS precision, {r6('r')} AS recall, {r6('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f1 FROM y LEFT JOIN a ON a.dim = y.dim AND a.value IS NOT DISTINCT FROM y.value""")
def detector_report(spark, sf):
    """The whole report on the detector: over all items, by regime and by level."""
    return E.detector_report(_items(spark, sf), "score", "fired", "positive", "control", ["regime", "ambiguity_k"])


_STORED = "SELECT DISTINCT result_id, task_id, model, fired, score FROM surfacing_results WHERE score >= 0 AND score <= 1 AND NOT isnan(score)"


@book(f"WITH s AS ({_STORED}), per AS (SELECT model, score, count(*) FILTER (fired) AS p, count(*) FILTER (NOT fired) AS q FROM s WHERE fired IS NOT NULL GROUP BY ALL), w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per) SELECT model, {_AUC} FROM w GROUP BY ALL")
def stored_auroc(spark, sf):
    s = table(spark, sf, "surfacing_results").where("score >= 0 AND score <= 1 AND NOT isnan(score)").select("result_id", "task_id", "model", "fired", "score").distinct()
    return E.auroc(s, "score", "fired", ["model"])


_BIN = f"{TIDY}, bins AS (SELECT CAST(least(floor(conf * 10), 9) AS INT) AS bin, count(*) AS n, avg(conf) AS conf, avg(CASE WHEN label = target THEN 1.0 ELSE 0.0 END) AS accuracy FROM tidy WHERE conf IS NOT NULL GROUP BY ALL)"


def _binned(spark, sf):
    return E.calibration(tidy(spark, sf).withColumn("correct", F.col("label") == F.col("target")), "conf", "correct")


@book(f"{_BIN} SELECT bin, n, {r6('conf')} AS conf, {r6('accuracy')} AS accuracy FROM bins")
def ece_bins(spark, sf):
    return _binned(spark, sf)


@book(f"{_BIN} SELECT {r6('sum(n * abs(conf - accuracy)) / sum(n)')} AS ece FROM bins")
def ece(spark, sf):
    return E.ece(_binned(spark, sf))


@book(f"{TIDY} SELECT model_class, {r6('coalesce(covar_pop(CASE WHEN label = target THEN 1.0 ELSE 0.0 END, conf) / nullif(var_pop(conf), 0), 0)')} AS slope, count(*) AS n FROM tidy WHERE conf IS NOT NULL GROUP BY ALL")
def conf_slope(spark, sf):
    return E.slope(tidy(spark, sf).withColumn("correct", (F.col("label") == F.col("target")).cast("double")), "conf", "correct", ["model_class"])


_CODERS = f"{TIDY}, c AS (SELECT family, label = target AS a, conf >= 0.6 AS b FROM tidy WHERE conf IS NOT NULL), k AS (SELECT family, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS pb FROM c GROUP BY ALL), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM k)"


@book(f"{_CODERS} SELECT family, n, {r6('po')} AS po, {r6('pe')} AS pe, {r6('CASE WHEN pe < 1 - 1e-12 THEN (po - pe) / (1 - pe) END')} AS kappa FROM e")
def cohen_kappa(spark, sf):
    t = tidy(spark, sf).where("conf IS NOT NULL").withColumns({"a": F.col("label") == F.col("target"), "b": F.col("conf") >= 0.6})
    return E.cohen_kappa(t, "a", "b", ["family"])


_Z = 1.959963984540054


@book(f"{TIDY}, x AS (SELECT model, count(*) AS n, count(*) FILTER (label <> target) AS k FROM tidy GROUP BY ALL) SELECT model, n, k, {r6(f'greatest(0, (k * 1.0 / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n))')} AS lo, {r6(f'least(1, (k * 1.0 / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n))')} AS hi FROM x")
def error_wilson(spark, sf):
    x = tidy(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("target")).alias("k"))
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return x.withColumn("lo", lo).withColumn("hi", hi)


# a stratified sample: every answer that the rules flag, and 40 of each other stratum by hash

_FLAG = "|".join(f"(?:{p})" for _, ps in X.ABSTENTION for p in ps if p not in X.GUARDED)


def _quote(p: str) -> str:
    return p.replace("'", "''")


def _signal_sql(c: str) -> str:
    resolved = f"regexp_matches({c}, '(?i){_quote(X.RESOLVED)}')"
    out = f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{X.COMMIT}'"
    for name, patterns in X.ABSTENTION:
        free = "|".join(f"(?:{p})" for p in patterns if p not in X.GUARDED)
        hit = f"regexp_matches({c}, '(?i){_quote(free)}')"
        for p in patterns:
            if p in X.GUARDED:
                hit += f" OR (regexp_matches({c}, '(?i){_quote(p)}') AND NOT {resolved})"
        out += f" WHEN {hit} THEN '{name}'"
    return out + f" ELSE '{X.COMMIT}' END"


_TEXTS = f"{TIDY}, sg AS (SELECT uid, regime, model_class, {_signal_sql('output')} AS signal FROM tidy)"


@book(f"{_TEXTS} SELECT regime, model_class, signal, grouping(regime, model_class) AS total, count(*) AS n FROM sg GROUP BY GROUPING SETS ((regime, model_class, signal), (signal))")
def abstention_table(spark, sf):
    t = tidy(spark, sf).select("regime", "model_class", X.abstention_signal(F.col("output")).alias("signal"))
    # texts are judged once; the total is a second grouping of the folded counts
    by = t.groupBy("regime", "model_class", "signal").agg(F.count(F.lit(1)).alias("n"))
    return by.groupingSets([["regime", "model_class", "signal"], ["signal"]], "regime", "model_class", "signal").agg((F.grouping("regime") * 2 + F.grouping("model_class")).cast("bigint").alias("total"), F.sum("n").alias("n"))


@book(f"{TIDY} SELECT uid, regexp_replace(regexp_replace(regexp_replace(output, '(?i)\\bInterpretation\\s+I\\d+(?:\\s*\\([^)\\n]{{0,80}}\\))?', '[interpretation]', 'g'), '\\bI_perp\\b', '[interpretation]', 'g'), '\\bI[0-7]\\b', '[option]', 'g') AS masked FROM tidy WHERE regexp_matches(output, '\\bI[0-7]\\b|\\bI_perp\\b|\\bInterpretation\\s+I\\d')")
def mask_ids(spark, sf):
    return tidy(spark, sf).where(X.leaks_label(F.col("output"))).select("uid", X.mask_labels(F.col("output")).alias("masked"))


def _kw(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.AXIS_STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1), lambda w: len(w) >= 3 AND w NOT IN ({stop})))"


@book(f"WITH q AS (SELECT {nk('id')} AS task, prompt, list_transform(key_questions, lambda k: {_kw('k')}) AS ks, {_kw('prompt')} AS d FROM tasks) SELECT task, coalesce(len(d) > 0 AND len(list_filter(ks, lambda k: len(k) > 0 AND len(list_intersect(d, k)) >= CASE WHEN len(k) <= 1 THEN 1 ELSE 2 END)) > 0, false) AS matched FROM q")
def axis_match(spark, sf):
    return table(spark, sf, "tasks").select(norm_key("id").alias("task"), X.axis_match(F.col("prompt"), F.col("key_questions")).alias("matched"))


_POP = f"""{_TEXTS}, lab AS (SELECT sg.uid, sg.signal <> '{X.COMMIT}' AS flagged, t.label, coalesce(t.conf < 0.4, false) AS human FROM sg JOIN tidy t USING (uid)),
st AS (SELECT *, CASE WHEN flagged THEN 'positive' WHEN label = 'I_perp' THEN 'iperp' WHEN regexp_matches(label, '^I\\d+$') THEN 'parseable' END AS stratum FROM lab),
sm AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS size, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(uid AS VARCHAR)), uid) AS k FROM st WHERE stratum IS NOT NULL), sample AS (SELECT * FROM sm WHERE stratum = 'positive' OR k <= 40)"""


def _sample(spark, sf):
    t = tidy(spark, sf)
    flagged = X.abstention_signal(F.col("output")) != X.COMMIT
    st = t.select("uid", flagged.alias("flagged"), "label", F.coalesce(F.col("conf") < 0.4, F.lit(False)).alias("human"))
    st = st.withColumn("stratum", F.when(F.col("flagged"), "positive").when(F.col("label") == "I_perp", "iperp").when(F.col("label").rlike(r"^I\d+$"), "parseable")).where("stratum IS NOT NULL")
    return stratified(st, "stratum", "uid", 40, census="positive")


def stratified(rows, stratum: str, uid: str, k: int, census: str):
    """All rows of one stratum and, of each other, the k with the smallest hashes of their ids, with the stratum's size.

    The smallest are found by a bounded aggregate in each task first, so no stratum is sorted as a whole.
    """
    h = F.md5(F.col(uid).cast("string"))
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    some = rows.where(F.col(stratum) != census).withColumn("_h", h)
    part = F.pmod(F.xxhash64(uid), F.lit(64))
    from pyspark.sql.window import Window as W

    first = some.withColumn("_k", F.row_number().over(W.partitionBy(stratum, part).orderBy("_h", uid))).where(F.col("_k") <= k)
    last = first.withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy("_h", uid))).where(F.col("_k") <= k)
    out = rows.where(F.col(stratum) == census).unionByName(last.drop("_k", "_h"))
    return out.join(F.broadcast(sizes), stratum)


@book(f"{_POP} SELECT uid, stratum, size FROM sample")
def stratified_sample(spark, sf):
    return _sample(spark, sf).select("uid", "stratum", "size")


@book(f"""{_POP}, g AS (SELECT stratum, max(size) * 1.0 AS bn, count(*) * 1.0 AS n, count(*) FILTER (human) AS h1, count(*) FILTER (flagged AND human) AS tp, count(*) FILTER (flagged AND NOT human) AS fp, count(*) FILTER (NOT flagged AND human) AS fn, count(*) FILTER (NOT flagged AND NOT human) AS tn FROM sample GROUP BY ALL),
w AS (SELECT sum(tp * bn / n) AS tp_pop, sum(fp * bn / n) AS fp_pop, sum(fn * bn / n) AS fn_pop, sum(tn * bn / n) AS tn_pop, sum(bn) AS n_total, sum(bn * h1 / n) / sum(bn) AS rate, sqrt(sum(CASE WHEN n > 1 THEN bn * bn * (1 - n / bn) * (h1 / n) * (1 - h1 / n) / (n - 1) ELSE 0 END) / (sum(bn) * sum(bn))) AS se FROM g),
pr AS (SELECT *, tp_pop / nullif(tp_pop + fp_pop, 0) AS p, tp_pop / nullif(tp_pop + fn_pop, 0) AS r FROM w)
SELECT {', '.join(f'{r6(c)} AS {c}' for c in ('tp_pop', 'fp_pop', 'fn_pop', 'tn_pop', 'n_total', 'rate'))}, {r6('p')} AS precision, {r6('r')} AS recall, {r6('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS f1, {r6(f'greatest(0, rate - {_Z} * se)')} AS rate_lo, {r6(f'least(1, rate + {_Z} * se)')} AS rate_hi FROM pr""")
def ht_population(spark, sf):
    return E.population(_sample(spark, sf), "stratum", "size", "flagged", "human")


# reports by item

_ITEM = f"""{TIDY}, c AS (SELECT task, model, target, label, count(*) AS n FROM tidy WHERE model IS NOT NULL GROUP BY ALL), m AS ({measures_sql('c', 'task, model')}),
ctx AS (SELECT {nk('task_id')} AS task, max(evidence.seed_entropy) AS h_ctx FROM (SELECT DISTINCT result_id, task_id, evidence FROM surfacing_results) GROUP BY ALL),
it AS (SELECT m.task, avg(entropy) AS h_seed, any_value(h_ctx) AS h_ctx, avg(1 - consistency) AS disagreement FROM m LEFT JOIN ctx USING (task) WHERE m.task IS NOT NULL GROUP BY ALL),
fl AS (SELECT it.*, ambiguity_k >= 1 AS positive, coalesce(h_ctx > 0.9, false) AS flagged, coalesce(h_ctx > 0.9 AND h_seed <= 0.5, false) AS danger FROM it JOIN task_facts USING (task))"""


def _item_rows(spark, sf):
    m = cells(tidy(spark, sf).where("model IS NOT NULL"), ["task", "model"])
    r = table(spark, sf, "surfacing_results").select("result_id", "task_id", "evidence.seed_entropy").distinct()
    ctx = r.select(norm_key("task_id").alias("task"), "seed_entropy").groupBy("task").agg(F.max("seed_entropy").alias("h_ctx"))
    it = m.groupBy("task").agg(F.avg("entropy").alias("h_seed"), F.avg(1 - F.col("consistency")).alias("disagreement")).join(ctx, "task", "left")
    facts = table(spark, sf, "tasks").select(norm_key("id").alias("task"), (F.col("ambiguity_level") >= 1).alias("positive"))
    high = F.col("h_ctx") > 0.9
    return it.join(facts, "task").withColumns({"flagged": F.coalesce(high, F.lit(False)), "danger": F.coalesce(high & (F.col("h_seed") <= 0.5), F.lit(False))})


@book(f"{_ITEM} SELECT task, {r6('h_seed')} AS h_seed, {r6('h_ctx')} AS h_ctx, {r6('disagreement')} AS disagreement, positive, flagged, danger FROM fl")
def item_aggregate(spark, sf):
    return _item_rows(spark, sf)


@book(f"{_ITEM} SELECT count(*) FILTER (positive) AS n_positive, count(*) FILTER (positive AND danger) AS n_danger, {r6('count(*) FILTER (positive AND danger) * 1.0 / nullif(count(*) FILTER (positive), 0)')} AS danger_mass, {r6('count(*) FILTER (NOT positive AND flagged) * 1.0 / nullif(count(*) FILTER (NOT positive), 0)')} AS false_rate FROM fl")
def danger_quadrant(spark, sf):
    p = F.col("positive")
    return _item_rows(spark, sf).agg(F.count_if(p).alias("n_positive"), F.count_if(p & F.col("danger")).alias("n_danger"), ratio(F.count_if(p & F.col("danger")), F.count_if(p)).alias("danger_mass"), ratio(F.count_if(~p & F.col("flagged")), F.count_if(~p)).alias("false_rate"))


_POLICIES = {"never": "false", "always": "true", "seed": "h_seed > 0.5", "context": "flagged", "either": "flagged OR h_seed > 0.5"}


@book(f"{_ITEM}, pl AS (SELECT positive, danger, unnest([{', '.join(f"{{'policy': '{k}', 'ask': {v}}}" for k, v in _POLICIES.items())}]) AS x FROM fl) SELECT x.policy AS policy, {r6('avg(CASE WHEN x.ask THEN 1.0 ELSE 0.0 END) FILTER (positive)')} AS appropriate, {r6('avg(CASE WHEN x.ask THEN 1.0 ELSE 0.0 END) FILTER (NOT positive)')} AS over, {r6('avg(CASE WHEN x.ask THEN 1.0 ELSE 0.0 END) FILTER (positive) - avg(CASE WHEN x.ask THEN 1.0 ELSE 0.0 END) FILTER (NOT positive)')} AS net, {r6('avg(CASE WHEN x.ask THEN 1.0 ELSE 0.0 END) FILTER (danger)')} AS danger_coverage FROM pl GROUP BY ALL")
def policy_table(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.expr(v).alias("ask")) for k, v in _POLICIES.items()]))
    rows = _item_rows(spark, sf).select("positive", "danger", each.alias("x")).select("positive", "danger", "x.policy", F.col("x.ask").cast("double").alias("ask"))
    a, o = F.avg(F.when(F.col("positive"), F.col("ask"))), F.avg(F.when(~F.col("positive"), F.col("ask")))
    return rows.groupBy("policy").agg(a.alias("appropriate"), o.alias("over"), (a - o).alias("net"), F.avg(F.when(F.col("danger"), F.col("ask"))).alias("danger_coverage"))


_W = 1.959963984540054


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k} * 1.0 / nullif({n}, 0))"
    bound = f"({p} + {_W * _W} / (2 * {n}) {sign} {_W} * sqrt({p} * (1 - {p}) / {n} + {_W * _W} / (4.0 * {n} * {n}))) / (1 + {_W * _W} / {n})"
    return f"greatest(0, {bound})" if sign == "-" else f"least(1, {bound})"


@book(f"{_ITEM}, pl AS (SELECT positive, unnest([{', '.join(f"{{'policy': '{k}', 'ask': {v}}}" for k, v in _POLICIES.items())}]) AS x FROM fl), g AS (SELECT x.policy AS policy, positive, count(*) FILTER (x.ask) AS k, count(*) AS n FROM pl GROUP BY ALL) SELECT policy, positive, k AS n_asked, n, {r6('k * 1.0 / n')} AS rate, {r6(_wilson_sql('k', 'n', '-'))} AS lo, {r6(_wilson_sql('k', 'n', '+'))} AS hi FROM g")
def policy_intervals(spark, sf):
    """Rates of asking of each policy on ambiguous and clear items, with their intervals."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.expr(v).alias("ask")) for k, v in _POLICIES.items()]))
    g = _item_rows(spark, sf).select("positive", each.alias("x")).groupBy("x.policy", "positive").agg(F.count_if("x.ask").alias("n_asked"), F.count(F.lit(1)).alias("n"))
    lo, hi = E.wilson(F.col("n_asked"), F.col("n"))
    return g.select("policy", "positive", "n_asked", "n", ratio(F.col("n_asked"), F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


@book(f"{_ITEM} SELECT positive, count(h_ctx) AS n, {r6('corr(h_seed, h_ctx)')} AS r FROM fl WHERE h_ctx IS NOT NULL AND h_seed IS NOT NULL AND NOT isnan(h_ctx) GROUP BY ALL HAVING count(*) > 1 AND stddev_pop(h_seed) > 0 AND stddev_pop(h_ctx) > 0")
def entropy_correlation(spark, sf):
    """Correlation of the entropy over seeds with that over contexts, where both vary."""
    own = _item_rows(spark, sf).where("h_ctx IS NOT NULL AND h_seed IS NOT NULL AND NOT isnan(h_ctx)")
    x, y = F.col("h_seed"), F.col("h_ctx")
    g = own.groupBy("positive").agg(F.count(F.lit(1)).alias("n"), pearson(F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)).alias("r"))
    return g.where("r IS NOT NULL")


@book(f"{CELLS} SELECT method, model_class, {r6('avg(cd_frozen)')} AS cd_frozen, {r6('avg(cd_primary)')} AS cd_primary, {r6('avg(iperp_rate)')} AS iperp_rate, {r6('sum(n_target) * 1.0 / sum(n_agents)')} AS resolve_rate FROM cells GROUP BY ALL")
def ensemble_diagnostics(spark, sf):
    return cells(tidy(spark, sf)).groupBy("method", "model_class").agg(F.avg("cd_frozen").alias("cd_frozen"), F.avg("cd_primary").alias("cd_primary"), F.avg("iperp_rate").alias("iperp_rate"), ratio(F.sum("n_target"), F.sum("n_agents")).alias("resolve_rate"))


#: Replicates as in the reference, and seed.
_B, _SEED = 2000, 42


@book(f"""{SURFACING}, b AS (SELECT unnest(range({_B})) AS b), w AS (SELECT b, task, {weight_sql(_SEED, 'b', 'task')} AS w FROM (SELECT DISTINCT task FROM items), b),
per AS (SELECT b, score, coalesce(sum(w) FILTER (positive), 0) AS p, coalesce(sum(w) FILTER (NOT positive), 0) AS q FROM items JOIN w USING (task) WHERE positive IS NOT NULL GROUP BY ALL),
x AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
a AS (SELECT b, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS a FROM x GROUP BY ALL), y AS (SELECT list_sort(list(a)) AS s, count(*) AS n FROM a WHERE a IS NOT NULL)
SELECT {r6('s[greatest(0, CAST(floor(n * 0.025) AS INT) - 1) + 1]')} AS lo, {r6('s[least(n - 1, CAST(floor(n * 0.975) AS INT)) + 1]')} AS hi FROM y""")
def auroc_boot(spark, sf):
    return auroc_ci(_items(spark, sf), "task", "score", "positive", _B, _SEED)


_RECOVERY = f"{TIDY}, rc AS (SELECT task, regime, avg(CASE WHEN label = target THEN 1.0 ELSE 0.0 END) AS recovery, count(*) AS n FROM tidy WHERE ambiguity_k >= 1 GROUP BY ALL)"


@book(f"{_RECOVERY} SELECT task, regime, {r6('recovery')} AS recovery, n FROM rc")
def recovery_by_item(spark, sf):
    return recovery(tidy(spark, sf).where("ambiguity_k >= 1"))


@book(f"{_RECOVERY}, m AS (SELECT avg(recovery) FILTER (regime = 'H2_derivable') AS h2, avg(recovery) FILTER (regime = 'H1_external') AS h1 FROM rc) SELECT {r6('h2')} AS mean_h2, {r6('h1')} AS mean_h1, CASE WHEN h2 >= 0.6 AND h1 <= 0.4 AND h2 - h1 >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m")
def recovery_verdict(spark, sf):
    return recovery_gate(recovery(tidy(spark, sf).where("ambiguity_k >= 1")))


@book(f"SELECT {nk('id')} AS task, CASE WHEN len(list_distinct(list_filter(list_transform(interpretations, lambda e: e.gold_check), lambda e: e IS NOT NULL))) >= 2 THEN 'AMB+' WHEN coalesce(len(key_questions), 0) > 0 THEN 'NON-DISC' ELSE 'AMB-' END AS stratum FROM tasks")
def gold_strata(spark, sf):
    checks = F.filter("interpretations.gold_check", lambda e: e.isNotNull())
    return table(spark, sf, "tasks").select(norm_key("id").alias("task"), gold_stratum(F.size(F.array_distinct(checks)), F.col("key_questions")).alias("stratum"))


# what pinning a dimension changes: the dimension is the method, its values the models, the answer the log confidence to a tenth

_PINS = f"""{TIDY}, pin AS (SELECT task, method, logit_conf AS v FROM tidy WHERE method IS NOT NULL), n AS (SELECT task, method, count(*) AS n_pins, count(v) AS n_parsed FROM pin GROUP BY ALL),
d AS (SELECT DISTINCT task, method, v FROM pin WHERE v IS NOT NULL), g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY task, method ORDER BY v) < 0.1 THEN 0 ELSE 1 END AS new FROM d),
k AS (SELECT task, method, v, sum(new) OVER (PARTITION BY task, method ORDER BY v) AS c FROM g), cl AS (SELECT task, method, c, count(*) AS n FROM pin JOIN k USING (task, method, v) GROUP BY ALL),
h AS (SELECT task, method, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h, count(*) AS n_clusters FROM cl GROUP BY ALL),
dims AS (SELECT n.task, n.method, n_pins, n_parsed, coalesce(n_clusters, 0) AS n_clusters, coalesce(h, 0) AS h_ctx FROM n LEFT JOIN h USING (task, method))"""


def _pins(spark, sf):
    places = F.array_position(F.array(*[F.lit(m) for m in _METHODS]), F.col("method"))
    return tidy(spark, sf).where("method IS NOT NULL").select("task", "method", places.alias("place"), F.col("logit_conf").alias("v"))


_METHODS = ["single", "sc", "homogeneous-mad", "heterogeneous-mad", "verifier", "interpretation-diverse"]


@book(f"{_PINS} SELECT task, method, n_parsed, n_clusters, {r6('h_ctx')} AS h_ctx FROM dims")
def pinned_entropy(spark, sf):
    return cluster_entropy(_pins(spark, sf), ["task", "method"], "v", 0.1)


@book(f"""{_PINS}, s AS (SELECT task, target, label, count(*) AS n FROM tidy GROUP BY ALL), m AS ({measures_sql('s', 'task')}),
x AS (SELECT task, sum(n_pins) AS n_pins, sum(n_parsed) AS n_parsed, arg_max({{'h': h_ctx, 'd': method}}, (round(h_ctx, 9), -list_position({_METHODS}, method))) AS b FROM dims GROUP BY ALL)
SELECT x.task, {r6('entropy')} AS h_seed, {r6('b.h')} AS h_ctx_max, CASE WHEN b.h > 0 THEN b.d END AS flagged_dimension, CAST(n_pins AS BIGINT) AS n_pins, CAST(n_parsed AS BIGINT) AS n_parsed, b.h > 0 AND entropy <= 0.5 AS is_flagged FROM x JOIN m USING (task)""")
def detector_record(spark, sf):
    """The whole record of a detector for each task: entropies, the dimension that matters, and the danger quadrant."""
    ctx = context_entropy(_pins(spark, sf), ["task"], "method", "place", "v", 0.1)
    seed = cells(tidy(spark, sf), ["task"]).select("task", F.col("entropy").alias("h_seed"))
    out = ctx.join(seed, "task")
    return out.select("task", "h_seed", "h_ctx_max", "flagged_dimension", "n_pins", "n_parsed", danger(F.col("h_ctx_max"), F.col("h_seed")).alias("is_flagged"))


@book(f"""{TIDY}, s AS (SELECT task, target, label, count(*) AS n FROM tidy GROUP BY ALL), m AS ({measures_sql('s', 'task')}), c AS (SELECT task, avg(exp(logit_conf)) AS conf FROM tidy GROUP BY ALL)
SELECT task, {r6('entropy')} AS seed_entropy, {r6('1 - conf')} AS token_logprob, {r6('1 - consistency')} AS self_consistency, CAST(coalesce(len(key_questions), 0) AS DOUBLE) AS requirements_probing FROM m JOIN c USING (task) JOIN task_facts USING (task)""")
def baseline_signals(spark, sf):
    """Scores that the detector is compared with; the stored confidences are mean log probabilities."""
    t = tidy(spark, sf)
    conf = t.groupBy("task").agg(F.avg(F.exp("logit_conf")).alias("conf"))
    q = table(spark, sf, "tasks").select(norm_key("id").alias("task"), F.size("key_questions").alias("q"))
    rows = cells(t, ["task"]).select("task", "entropy", "consistency").join(conf, "task").join(q, "task")
    return rows.select("task", *baseline_scores(F.col("entropy"), F.col("conf"), F.col("consistency"), F.col("q")))


@book(rf"""WITH d AS (SELECT {nk('id')} AS task, list_distinct(list_filter(list_transform(interpretations, lambda e: regexp_replace(e.gold_check, '^\s+|\s+$', '', 'g')), lambda v: v <> '')) AS v, regexp_replace(domain, '^\s+|\s+$', '', 'g') AS name FROM tasks) SELECT task, CASE WHEN len(v) >= 2 AND name <> '' THEN 1 ELSE 0 END AS n_dimensions, CASE WHEN len(v) >= 2 AND name <> '' THEN len(v) ELSE 0 END AS n_values FROM d""")
def dimensions_of_tasks(spark, sf):
    """Dimensions that a task's interpretations span, after cleaning: the domain with the checks as values."""
    dims = F.array(F.struct(F.col("domain").alias("dimension"), F.col("interpretations.gold_check").alias("values")))
    d = table(spark, sf, "tasks").select(norm_key("id").alias("task"), X.clean_dimensions(dims).alias("d"))
    return d.select("task", F.size("d").alias("n_dimensions"), F.coalesce(F.aggregate("d", F.lit(0), lambda acc, x: acc + F.size(x["values"])), F.lit(0)).alias("n_values"))


@book()
def reasoning_stripped(spark, sf):
    """Characters of answers with and without reasoning, by model."""
    t = tidy(spark, sf).where("output IS NOT NULL").select("model", F.length("output").alias("n"), F.length(X.strip_reasoning("output")).alias("m"))
    return t.groupBy("model").agg(F.sum("n").alias("n_chars"), F.sum("m").alias("n_answer_chars"))


@book()
def code_blocks(spark, sf):
    """Answers by the number of Python blocks they hold."""
    return tidy(spark, sf).where("output IS NOT NULL").groupBy(F.size(X.python_blocks("output")).alias("n_blocks")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = book.queries, book.sql
