"""Weights, null models, order statistics and linear models against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensio.operators import linear, nulls, order, resample
from consensio.operators.evaluation import auroc, mid_rank
from consensio.operators.detector import cluster_entropy, context_entropy, tolerance_clusters

COUNTS = "task string, model string, k int, n_interpretations int, target string, label string, n bigint"


def test_weights_are_poisson():
    w = np.concatenate([resample.weights(7, f"level{i}", 2000) for i in range(50)]).astype(int)
    n = Counter(w.tolist())
    for k in range(5):
        assert n[k] / len(w) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)
    assert (resample.weights(7, "a", 10) == resample.weights(7, "a", 500)[:10]).all() and not (resample.weights(7, "a", 50) == resample.weights(8, "a", 50)).all()


def measure(labels, target="I0"):
    wrong = Counter(x for x in labels if x not in (target, "I_perp"))
    return max(wrong.values(), default=0) / len(labels)


def counts_of(spark, agents):
    return spark.createDataFrame(agents, "task string, model string, k int, n_interpretations int, target string, label string").groupBy("task", "model", "k", "n_interpretations", "target", "label").agg(F.count(F.lit(1)).alias("n"))


AGENTS = [("a", "m", 1, 3, "I0", x) for x in ("I1", "I1", "I2", "I0")] + [("b", "m", 1, 3, "I0", x) for x in ("I0", "I_perp", "I1")] + [("c", "n", 2, 0, "I0", "I2")]


def test_uniform_null_equals_enumeration(spark):
    want = np.mean([np.mean([measure(x) for x in itertools.product(["I0", "I1", "I2"], repeat=n)]) for n in (4, 3)])
    got = {r["k"]: r["mean"] for r in nulls.uniform(counts_of(spark, AGENTS), ["task", "k"], "n_interpretations", ["k"], 4000).groupBy("k").agg(F.avg("mean").alias("mean")).collect()}
    assert got[1] == pytest.approx(want, abs=0.01) and got[2] == 0


@pytest.mark.parametrize("chunk", [500, 1])
def test_shuffled_null_equals_enumeration(spark, monkeypatch, chunk):
    monkeypatch.setattr(nulls, "CHUNK_CELLS", chunk)
    pool = [x[5] for x in AGENTS if x[1] == "m"]
    deals = {tuple(pool[i] for i in p) for p in itertools.permutations(range(7))}
    total = Counter(tuple(pool[i] for i in p) for p in itertools.permutations(range(7)))
    want = sum(total[d] * (measure(d[:4]) + measure(d[4:])) / 2 for d in deals) / sum(total.values())
    c = counts_of(spark, AGENTS)
    reps = nulls.shuffled(c, ["task", "model", "k"], ["model", "k"], ["model"], 4000)
    got = {r["model"]: r["mean"] for r in reps.groupBy("model").agg(F.avg("mean").alias("mean")).collect()}
    assert got["m"] == pytest.approx(want, abs=0.01) and got["n"] == 1.0  # one cell alone is only dealt to itself
    expected = {r["model"]: r["mean"] for r in nulls.shuffled(c, ["task", "model", "k"], ["model", "k"], ["model"], 4000, expected=True).collect()}
    assert expected["m"] == pytest.approx(got["m"], abs=1e-9)


def test_deal_keeps_the_pool():
    rng = np.random.default_rng(0)
    pool = np.tile(np.array([5, 0, 7, 3]), (50, 1))
    out = list(nulls.deal(rng, pool, [4, 1, 10]))
    assert [set(x.sum(1)) for x in out] == [{4}, {1}, {10}] and (sum(out) == pool).all()
    big = nulls._hypergeometric(rng, np.full(2000, 3 * 10**9), np.full(2000, 10**9), np.full(2000, 1000))
    assert big.mean() == pytest.approx(750, abs=2) and big.std() == pytest.approx(math.sqrt(1000 * 0.75 * 0.25), rel=0.1)


def test_redrawn_null_equals_enumeration(spark):
    c = counts_of(spark, AGENTS)
    pool = c.groupBy("model", "label").agg(F.sum("n").alias("n"))
    own = Counter(x[5] for x in AGENTS if x[1] == "m")
    p = {k: v / 7 for k, v in own.items()}
    want = np.mean([sum(math.prod(p[x] for x in d) * measure(d) for d in itertools.product(p, repeat=n)) for n in (4, 3)])
    reps = nulls.redrawn(c, ["task", "k"], pool, ["k"], "model", 4000)
    got = {r["k"]: r["mean"] for r in reps.groupBy("k").agg(F.avg("mean").alias("mean")).collect()}
    assert got[1] == pytest.approx(want, abs=0.01) and got[2] == 1.0
    g = {r["k"]: r for r in nulls.gap(c, ["task", "k"], reps, ["k"]).collect()}
    assert g[1]["observed"] == pytest.approx((0.5 + 1 / 3) / 2) and g[1]["lo"] < g[1]["delta"] < g[1]["hi"] and g[1]["n_cells"] == 2


def test_nulls_of_nothing(spark):
    c = counts_of(spark, AGENTS).limit(0)
    assert nulls.uniform(c, ["task", "k"], "n_interpretations", ["k"], 10).count() == 0
    assert nulls.shuffled(c, ["task", "model", "k"], ["model", "k"], ["model"], 10).count() == 0
    assert nulls.redrawn(c, ["task", "k"], c.select("model", "label", "n"), ["k"], "model", 10).count() == 0


def test_null_keys_are_groups(spark):
    c = counts_of(spark, [("a", "m", None, 2, "I0", "I1"), ("b", "m", 3, 2, "I0", "I1")])
    got = nulls.gap(c, ["task", "k"], nulls.uniform(c, ["task", "k"], "n_interpretations", ["k"], 50), ["k"])
    assert sorted((r["k"] or -1) for r in got.collect()) == [-1, 3]
    got = nulls.shuffled(c, ["task", "model", "k"], ["model", "k"], ["k"], 5)
    assert sorted({(r["k"] or -1) for r in got.collect()}) == [-1, 3]


def test_cell_replicates_equal_brute_force(spark):
    rows = [("a", "m", "I1", 2), ("a", "n", "I0", 1), ("a", "n", "I2", 3), ("b", "m", "I0", 1), ("b", "n", "I1", 1)]
    c = spark.createDataFrame(rows, "task string, model string, label string, n bigint").withColumn("target", F.lit("I0"))
    for how in ("two-way", "task"):
        got = {r["b"]: r["mean"] for r in resample.cell_replicates(c, ["task"], [], 40, 3, how).collect()}
        for b in range(40):
            num = den = 0
            for t in ("a", "b"):
                n = Counter()
                for task, model, label, k in rows:
                    if task == t:
                        n[label] += k * (int(resample.weights(4, model, 40)[b]) if how == "two-way" else 1)
                w = int(resample.weights(3, t, 40)[b])
                if sum(n.values()):
                    num += w * max(n["I1"], n["I2"]) / sum(n.values())
                    den += w
            assert got[b] == (None if not den else pytest.approx(num / den)), (how, b)
    agents = [r["mean"] for r in resample.cell_replicates(c, ["task"], [], 2000, 3, "agent").collect()]
    assert 0.3 < np.nanmean([x for x in agents if x is not None]) < 0.8
    assert resample.cell_replicates(c.limit(0), ["task"], [], 10).count() == 0


@pytest.mark.parametrize("distinct", [3, 500])
def test_order_equals_sorting(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.choice(["x", "y", None]), float(rng.randrange(distinct)) if rng.random() < 0.95 else None, rng.random() < 0.4) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, p boolean").repartition(7)
    got = {r["g"]: r for r in order.percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}).collect()}
    area = {r["g"]: r["auroc"] for r in auroc(df, "v", "p", ["g"]).collect()}
    for g in ("x", "y", None):
        own = [v for k, v, _ in rows if k == g and v is not None]
        for n, p in (("a", 50), ("b", 90), ("c", 0), ("d", 100)):
            assert got[g][n] == pytest.approx(np.percentile(own, p))
        pos, neg = ([v for k, v, q in rows if k == g and v is not None and q is side] for side in (True, False))
        assert area[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    ranked = mid_rank(df.where("g = 'x'"), "v", ["g"]).collect()
    own = sorted(v for k, v, _ in rows if k == "x" and v is not None)
    for r in ranked[:200]:
        below, same = sum(v < r["v"] for v in own), own.count(r["v"])
        assert r["mid_rank"] == below + (same + 1) / 2 and r["competition_rank"] == len(own) - below - same + 1
    assert order.percentiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_clusters_equal_union_find(spark):
    rng = random.Random(1)
    rows = [(g, round(rng.random() * 3, 3), rng.choice("pq")) for g in "xy" for _ in range(300)] + [("z", None, "p"), ("z", 1.0, "p")]
    df = spark.createDataFrame(rows, "g string, v double, d string").repartition(5)
    got = tolerance_clusters(df, ["g"], "v", 0.02).collect()
    for g in "xyz":
        values = sorted({v for k, v, _ in rows if k == g and v is not None})
        label, c = {}, 0
        for i, v in enumerate(values):
            c += i == 0 or v - values[i - 1] >= 0.02
            label[v] = c
        assert all(r["cluster"] == label[r["v"]] for r in got if r["g"] == g)
    e = {r["g"]: r for r in cluster_entropy(df, ["g"], "v", 0.02).collect()}
    n = Counter(r["cluster"] for r in got if r["g"] == "x")
    assert e["x"]["h_ctx"] == pytest.approx(-sum(k / 300 * math.log2(k / 300) for k in n.values())) and e["z"]["h_ctx"] == 0 and e["z"]["n_parsed"] == 1
    pins = spark.createDataFrame([("t", "d1", 0, 1.0), ("t", "d1", 0, 2.0), ("t", "d0", 1, 3.0), ("t", "d0", 1, 5.0), ("u", "d0", 0, 1.0), ("u", "d0", 0, None), ("w", "d", 0, None)], "item string, dim string, place int, v double")
    r = {x["item"]: x for x in context_entropy(pins, ["item"], "dim", "place", "v").collect()}
    assert (r["t"]["h_ctx_max"], r["t"]["flagged_dimension"], r["t"]["n_pins"], r["t"]["n_parsed"]) == (1.0, "d1", 4, 4)
    assert (r["u"]["h_ctx_max"], r["u"]["flagged_dimension"], r["u"]["n_parsed"]) == (0.0, None, 1) and r["w"]["h_ctx_max"] == 0.0


def test_linear_models(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = rng.normal(0, 2)
        rows += [(f"g{g}", float(x), "q" if k % 2 else "p", float(base + 1.5 * x + (k % 2) * 0.7 + rng.normal(0, 0.3))) for k, x in enumerate(rng.normal(0, 1, 6))]
    df = spark.createDataFrame(rows, "g string, x double, f string, y double").repartition(6)
    assert linear.varying(df.withColumn("one", F.lit(1)), ["x", "one", "f"]) == ["x", "f"]
    d, names = linear.design(df, ["x"], {"f": ["p", "q"]}, [("x", "f")])
    assert names == ["intercept", "x", "f[q]", "x:f[q]"]
    r = linear.fit(d, "y", names, "g")
    assert r["status"] == "ok:single_re"
    assert r["beta"][1] == pytest.approx(1.5, abs=0.1) and r["beta"][2] == pytest.approx(0.7, abs=0.12) and abs(r["beta"][3]) < 0.12
    point, lo, hi, status = linear.interval(r, "x")
    assert lo < point < hi and hi - lo < 0.2 and linear.interval(r, "none") == (None, None, None, "absent")
    # least squares where clusters do not differ
    flat = spark.createDataFrame([(f"g{k % 40}", float(k % 5), float(2 * (k % 5) + (-1) ** (k // 40 + k))) for k in range(400)], "g string, x double, y double")
    d, names = linear.design(flat, ["x"])
    r = linear.fit(d, "y", names, "g")
    x, y = np.array([k % 5 for k in range(400)], float), np.array([2 * (k % 5) + (-1) ** (k // 40 + k) for k in range(400)], float)
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert r["beta"] == pytest.approx(want, abs=1e-6)
    d, names = linear.design(flat.withColumn("z", F.col("x") * 2), ["x", "z"])
    assert linear.fit(d, "y", names, "g")["status"] == "rank-deficient"
    assert linear.fit(d.limit(0), "y", names, "g")["status"] == "too-few-clusters"
