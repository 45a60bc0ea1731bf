"""Hand-computed values of label measures and of scores against truth."""

import math
import random

import pytest
from pyspark.sql import functions as F

from consensio.operators import contrasts as C
from consensio.operators import decide as V
from consensio.operators import dependence as D
from consensio.operators import evaluation as E
from consensio.operators import nulls as N
from consensio.operators import resample as R
from consensio.operators.completeness import compare_grids, merge_shards, refuse_conflicts
from consensio.operators.detector import surfacing, tolerance_clusters
from consensio.operators.labels import CELL, cells, label_counts, modal_wrong


def frame(spark, groups, target="I0"):
    rows = [(uid * 1000 + i, f"t{uid}", "single", f"m/{i % 3}", f"f{i % 2}", "weak", 0, label, target, "H1_external", 1, 2) for uid, labels in enumerate(groups) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "uid bigint, task string, method string, model string, family string, model_class string, seed bigint, label string, target string, regime string, ambiguity_k int, n_interpretations int")


@pytest.mark.parametrize(
    ("labels", "frozen", "primary", "drop", "perp", "maj"),
    [
        (["I1", "I1", "I_perp", "I_perp", "I_perp"], 0.6, 0.4, 1.0, 0.6, 0),
        (["I1"] * 5, 1.0, 1.0, 1.0, 0.0, 0),
        (["I1", "I2", "I3", "I_perp", "I_perp"], 0.4, 0.2, 1 / 3, 0.4, 0),
        (["I0", "I0", "I1", "I1", "I1"], 0.6, 0.6, 0.6, 0.0, 0),
        (["I1"] * 4 + ["I0"], 0.8, 0.8, 0.8, 0.0, 0),
        (["I0", "I0", "I1", "I1"], 0.5, 0.5, 0.5, 0.0, 0),
        (["I_perp"] * 3, 1.0, 0.0, 0.0, 1.0, 0),
        (["I0", "I0", "I1"], 1 / 3, 1 / 3, 1 / 3, 0.0, 1),
    ],
)
def test_cell_measures(spark, labels, frozen, primary, drop, perp, maj):
    r = cells(frame(spark, [labels])).first()
    assert [r[c] for c in ("cd_frozen", "cd_primary", "cd_drop_iperp", "iperp_rate")] == pytest.approx([frozen, primary, drop, perp])
    assert r["a_maj"] == maj


def test_entropy_and_pairs(spark):
    r = cells(frame(spark, [["I0", "I1", "I1", "I2"]])).first()
    assert r["entropy"] == pytest.approx(1.5)
    assert r["entropy_norm"] == pytest.approx(1.5 / math.log2(3))
    assert r["pairwise_wrong"] == pytest.approx(1 / 3)
    assert r["consistency"] == 0.5
    one = cells(frame(spark, [["I0"]])).first()
    assert one["entropy"] == 0 and one["divergence"] == 0 and one["pairwise_wrong"] is None


def test_cells_of_nothing_and_null_keys(spark):
    f = frame(spark, [["I0"]])
    assert cells(f.limit(0)).count() == 0
    assert cells(f.withColumn("regime", F.lit(None).cast("string"))).first()["n_agents"] == 1


def test_modal_wrong_breaks_ties_downwards(spark):
    counts = label_counts(frame(spark, [["I2", "I1", "I0", "I_perp", "I_perp"], ["I0"]]), ["task"])
    assert [tuple(r) for r in modal_wrong(counts, ["task"]).collect()] == [("t0", "I1", 1)]


def test_order_of_rows_is_no_matter(spark):
    f = frame(spark, [["I0", "I1", "I1"], ["I2", "I0"]])
    a, b = cells(f.repartition(5)).orderBy("task").collect(), cells(f.orderBy(F.rand(3))).orderBy("task").collect()
    assert a == b


def test_kappa_icc_rho_and_size(spark):
    f = frame(spark, [["I0"] * 4, ["I1"] * 4])
    assert D.fleiss_kappa(label_counts(f), ["method"], ["task", "regime", "ambiguity_k"]).first()["kappa"] == pytest.approx(1.0)
    c = cells(f).withColumn("n_wrong", F.col("n_agents") - F.col("n_target"))
    assert D.icc(c, ["method"]).first()["icc"] == pytest.approx(1.0)
    errors = f.withColumn("e", (F.col("label") != F.col("target")).cast("double"))
    assert tuple(D.marginal_rho(errors, "model", "task", "e").first()) == (pytest.approx(1.0), 3)
    assert D.marginal_rho(errors.withColumn("e", F.lit(1.0)), "model", "task", "e").first()["rho"] == 0.0
    n = spark.range(1).select(*[D.effective_size(F.lit(float(a)), F.lit(b)).alias(k) for k, a, b in (("x", 10, 0.5), ("y", 1, 0.3), ("z", 2, -1.0))]).first()
    assert tuple(n) == (pytest.approx(10 / 5.5), 1.0, 2.0)


def test_auroc_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(300)] + [("c", 0.1, True)]
    got = {r["g"]: r["auroc"] for r in E.auroc(spark.createDataFrame(rows, "g string, s double, p boolean"), "s", "p", ["g"]).collect()}
    for g in "ab":
        pos, neg = [s for k, s, p in rows if k == g and p], [s for k, s, p in rows if k == g and not p]
        assert got[g] == pytest.approx(sum((x > y) + (x == y) / 2 for x in pos for y in neg) / len(pos) / len(neg))
    assert got["c"] is None


def test_confusion_slope_ece_kappa_wilson(spark):
    df = spark.createDataFrame([(True, True)] * 2 + [(True, False), (False, True), (False, False)], "d boolean, h boolean")
    r = E.confusion(df, "d", "h").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((2 / 3,) * 3)
    x = spark.createDataFrame([(0.2, 0.0), (0.4, 0.0), (0.6, 1.0), (0.8, 1.0), (None, 1.0)], "c double, y double")
    assert E.slope(x, "c", "y").first()["slope"] == pytest.approx(2.0)
    assert E.slope(x.withColumn("c", F.lit(1.0)), "c", "y").first()["slope"] == 0.0
    b = E.calibration(x.withColumn("y", F.col("y") == 1), "c", "y")
    assert E.ece(b).first()[0] == pytest.approx(0.3)
    assert E.calibration(spark.createDataFrame([(1.0, True)], "c double, y boolean"), "c", "y").first()["bin"] == 9
    assert E.cohen_kappa(df.where("d"), "d", "d").first()["kappa"] is None
    lo, hi = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int").select(*E.wilson(F.col("k"), F.col("n"))).collect()[0]
    assert (lo, hi) == pytest.approx((0.2366, 0.7634), abs=1e-4)


def test_threshold_equals_brute_force(spark):
    rng = random.Random(2)
    for target in (0.1, 0.5):
        rows = [(round(rng.random(), 1), k) for k in [0] * 15 + [1] * 15]
        got = E.threshold(spark.createDataFrame(rows, "s double, k int").selectExpr("s", "k = 0 AS c", "k = 1 AS p"), "s", "c", "p", target).first()
        cand = sorted({0.0, 1 + 1e-9} | {s for s, _ in rows} | {s + 1e-9 for s, _ in rows})
        best, top = None, -1.0
        for t in cand:
            fpr = sum(s >= t for s, k in rows if not k) / 15
            rec = sum(s >= t for s, k in rows if k) / 15
            if t <= 1 + 1e-9 and fpr < target and rec > top + 1e-12:
                best, top = t, rec
        assert got["threshold"] == pytest.approx(best, abs=1e-12) and got["recall"] == pytest.approx(top)
    empty = E.threshold(spark.createDataFrame([], "s double, c boolean, p boolean"), "s", "c", "p").first()
    assert empty["recall"] == 0.0


def test_population_weights(spark):
    rows = [("pos", 2, True, True), ("pos", 2, True, False), ("perp", 10, False, True), ("perp", 10, False, False), ("ok", 100, False, False), ("ok", 100, False, False)]
    r = E.population(spark.createDataFrame(rows, "s string, n int, d boolean, h boolean"), "s", "n", "d", "h").first()
    assert (r["tp_pop"], r["fp_pop"], r["fn_pop"], r["tn_pop"]) == (1.0, 1.0, 5.0, 105.0)
    assert r["recall"] == pytest.approx(1 / 6) and r["rate"] == pytest.approx(6 / 112)


def test_nulls_recover_an_injected_effect(spark):
    f = frame(spark, [[f"I{i % 4}"] * 6 for i in range(12)])
    keys = ["task", "regime", "method"]
    counts = label_counts(f, [*keys, "model", "n_interpretations"])
    whole = counts.groupBy(*keys, "target", "label").agg(F.sum("n").alias("n"))
    gap = N.gap(whole, keys, N.shuffled(whole, keys, ["method"], ["regime"], 50, 1), ["regime"]).first()
    assert gap["observed"] == 0.75 and gap["delta"] > 0.2 and gap["lo"] > 0
    uni = N.gap(whole, keys, N.uniform(counts, keys, "n_interpretations", ["regime"], 200, 1), ["regime"]).first()
    assert uni["null_mean"] == pytest.approx(0.5, abs=0.05)


def test_bootstrap_interval_holds_the_mean(spark):
    v = spark.createDataFrame([(f"t{i}", float(i % 5)) for i in range(60)], "t string, v double")
    r = R.mean_ci(v, "t", "v", 200, 1).first()
    assert r["lo"] < r["point"] == 2.0 < r["hi"]
    assert R.mean_ci(v.limit(0), "t", "v", 10, 1).first()["lo"] is None


def test_two_way_weights_equal_relabelled_occurrences(spark):
    rng = random.Random(5)
    f = frame(spark, [[rng.choice(["I0", "I1", "I2", "I_perp"]) for _ in range(6)] for _ in range(5)])
    got = {r["b"]: r["mean"] for r in R.cell_replicates(label_counts(f, [*CELL, "model"]), CELL, [], 30, 9).collect()}
    data = f.select("task", "model", "label").collect()
    for b, v in got.items():
        values = []
        for task in {r["task"] for r in data}:
            labels = [r["label"] for r in data if r["task"] == task for _ in range(int(R.weights(10, r["model"], 30)[b]))]
            if labels:
                wrong = [x for x in labels if x not in ("I0", "I_perp")]
                values += [max([wrong.count(x) for x in set(wrong)] or [0]) / len(labels)] * int(R.weights(9, task, 30)[b])
        assert v == (pytest.approx(sum(values) / len(values)) if values else None)


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1), (None, 0.1), (0.0, 0.1)], "lo double, hi double")
    assert [r[0] for r in rows.select(V.verdict(F.col("lo"), F.col("hi"))).collect()] == ["SUPPORTED", "REFUTED", "INCONCLUSIVE", "INCONCLUSIVE", "INCONCLUSIVE"]
    assert rows.where("lo = 0").select(V.verdict(F.col("lo"), F.col("hi"), True)).first()[0] == "SUPPORTED"
    tags = spark.createDataFrame([(1.0, 2.0), (1.0, -1.0), (1.0, None), (None, None)], "a double, b double").select(V.robustness([F.col("a"), F.col("b")])).collect()
    assert [t[0] for t in tags] == ["robust:+", "divergent", "robust:+(partial)", "indeterminate"]
    h2 = spark.createDataFrame([(0.1, 0.2, -0.1), (0.1, 0.2, 0.1), (-0.1, 0.2, None)], "a double, b double, c double").select(V.verdict_h2(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [t[0] for t in h2] == ["SUPPORTED", "REFUTED", "INCONCLUSIVE"]


def test_t_distribution_tost_and_holm():
    assert V.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert V.tost(1, 0, 0, 0.1)["p"] is None and V.tost(5, 0.0, 0.0, 0.1)["equivalent"] and not V.tost(5, 0.2, 0.0, 0.1)["equivalent"]
    assert V.tost(40, 0.01, 0.05, 0.1)["equivalent"]
    assert V.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_surfacing_ignores_lone_strays(spark):
    f = frame(spark, [["I0"] * 5 + ["I1"], ["I0", "I1"] * 3, ["I_perp"] * 3])
    q = spark.createDataFrame([("t1", ["which?"]), ("t0", ["no"])], "task string, key_questions array<string>")
    got = {r["task"]: r for r in surfacing(f, q).collect()}
    assert got["t0"]["s_div"] == 0 and not got["t0"]["fired"]
    assert got["t1"]["fired"] and got["t1"]["axes"] == ["which?"]
    assert got["t2"]["score"] == 0


def test_tolerance_clusters_are_components(spark):
    rows = [("a", x) for x in (0.0, 0.05, 0.1, 0.3, 0.3, 0.35)] + [("b", 1.0), ("b", None)]
    got = tolerance_clusters(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.06).groupBy("g", "cluster").count().orderBy("g", "cluster").collect()
    assert [tuple(r) for r in got] == [("a", 1, 3), ("a", 2, 3), ("b", 1, 1)]


def test_grids_and_shards(spark):
    e = spark.createDataFrame([("a", 0, 2), ("b", 0, 1), ("c", 0, 1)], "t string, s int, least int")
    o = spark.createDataFrame([("a", 0), ("b", 0), ("d", 0)], "t string, s int")
    got = {r["t"]: r["status"] for r in compare_grids(e, o, ["t", "s"]).collect()}
    assert got == {"a": "underfilled", "b": "ok", "c": "missing", "d": "unexpected"}
    m = merge_shards(spark.createDataFrame([("k", 1), ("k", 1), ("j", 1), ("j", 2)], "k string, v int"), ["k"], ["v"])
    assert {r["k"]: (r["n_read"], r["n_distinct"]) for r in m.collect()} == {"k": (2, 1), "j": (2, 2)}
    with pytest.raises(ValueError, match="disagree"):
        refuse_conflicts(m)


def test_contrasts(spark):
    f = frame(spark, [["I1", "I0"], ["I1", "I1"]])
    c = cells(f.unionByName(f.withColumn("method", F.lit("sc")).where("task = 't1'")))
    r = C.against_single(c).first()
    assert r["method"] == "sc" and r["cd_primary_delta"] == pytest.approx(0.25)
    assert C.paired_delta(c, "sc", "single").first()["delta"] == 0.0
    assert {r["model"] for r in C.with_pooled(f, "model").select("model").distinct().collect()} >= {"POOLED", "m/0"}
