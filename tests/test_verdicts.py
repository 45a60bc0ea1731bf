"""All verdicts and the gate on tables with known effects, and on tables with nothing to decide."""

import random

import pytest
from pyspark.sql import functions as F

from consensio.operators import verdicts as S
from consensio.operators.dependence import dependence_cells, dependence_summary
from consensio.operators.labels import cells, label_counts

TIDY = "uid bigint, task string, method string, model_class string, model string, family string, constructor_family string, seed bigint, regime string, ambiguity_k int, n_interpretations int, target string, label string"


def study(spark, worse: float = 0.25):
    """External tasks of four levels; wrong answers grow with the level, more so where answers are aggregated, and hardly occur on derivable ones."""
    rng, rows = random.Random(4), []
    for t in range(40):
        regime, k = ("H1_external", t % 4) if t < 28 else ("H2_derivable", 1 + t % 2)
        for method, n in (("single", 3), ("sc", 5)):
            for model, kind in (("a/x", "weak"), ("b/y", "reasoning"), ("c/z", "weak"), ("d/w", "reasoning")):
                for seed in (0, 1):
                    p = min(0.9, 0.2 * k + (worse if method != "single" else 0)) if regime == "H1_external" else 0.05
                    for _ in range(n):
                        label = f"I{1 + t % max(1, 2**k - 1)}" if k and rng.random() < p else "I0"
                        rows.append((len(rows), f"t{t}", method, kind, model, model[0], "a" if t % 2 else "q", seed, regime, k, 2**k, "I0", label))
    return spark.createDataFrame(rows, TIDY)


def test_evaluate(spark):
    got = {r["hypothesis"]: r for r in S.evaluate(study(spark), b=60, n_perm=20).collect()}
    assert set(got) == {"H1a", "H1b", "H2_interaction", "H2_reasoner_vs_single", "R1", "R2"}
    assert got["H1a"]["verdict"] == got["H1b"]["verdict"] == got["R1"]["verdict"] == got["R2"]["verdict"] == "SUPPORTED"
    assert got["H1b"]["point"] == pytest.approx(0.2, abs=0.05) and got["H1b"]["status"].startswith("ok")
    assert got["H1a"]["lo"] <= got["H1a"]["point"] <= got["H1a"]["hi"] and got["H2_interaction"]["verdict"] == got["H2_reasoner_vs_single"]["verdict"] != "REFUTED"
    fewer = {r["hypothesis"]: r["verdict"] for r in S.evaluate(study(spark, -0.3), b=60, n_perm=20).collect()}
    assert fewer["H1a"] == "REFUTED"


def test_evaluate_nothing(spark):
    got = S.evaluate(study(spark).limit(0), b=10, n_perm=5).collect()
    assert len(got) == 6 and {r["verdict"] for r in got} == {"INCONCLUSIVE"}


def test_gate(spark):
    got = {r["check"]: r for r in S.pilot_gate(study(spark), b=100, n_perm=20).collect()}
    assert got["golden"]["passed"] and got["cardinality"]["passed"] and got["R1a"]["passed"] and got["degenerate"]["passed"]
    assert got["R1b"]["passed"] is not None and got["R1a"]["lo"] < got["R1a"]["value"]
    bad = study(spark).withColumn("n_interpretations", F.lit(3)).withColumn("label", F.when(F.col("uid") % 2 == 0, "I_perp").otherwise(F.col("label")))
    got = {r["check"]: r for r in S.pilot_gate(bad, b=100, n_perm=20).collect()}
    assert not got["cardinality"]["passed"] and not got["degenerate"]["passed"]


def test_dependence_tables(spark):
    counts = label_counts(study(spark))
    per = dependence_cells(counts)
    assert per.count() == cells(study(spark)).count() and per.where("kappa IS NOT NULL").select("kappa", "method", "model_class", "seed").distinct().count() <= 8
    summary = {r["regime"]: r for r in dependence_summary(counts).collect()}
    assert 0 < summary["H1_external"]["icc"] < 1 and summary["H1_external"]["n_eff"] > 1
    assert dependence_summary(counts.limit(0)).count() == 0
