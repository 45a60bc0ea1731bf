"""Estimating equations against plain solutions and known effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensio.operators import gee
from consensio.operators.linear import design


def test_balanced_gaussian_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(40):
        u = rng.normal(0, 1)
        rows += [(g, float(x), float(2 + 0.5 * x + u + rng.normal(0, 0.4))) for x in range(6)]
    d, names = design(spark.createDataFrame(rows, "g int, x double, y double").repartition(5), ["x"])
    r = gee.fit(d, "y", names, "g")
    x, y = np.array([[1, v[1]] for v in rows]), np.array([v[2] for v in rows])
    # with the same x in every cluster the exchangeable weights do not change the slope
    assert r["status"] == "ok" and r["beta"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-6) and r["alpha"] > 0.6
    est, se, z = gee.contrast(r, {"x": 1.0})
    slopes = [np.polyfit(range(6), [v[2] for v in rows if v[0] == g], 1)[0] for g in range(40)]
    assert se == pytest.approx(np.std(slopes, ddof=1) / np.sqrt(40), rel=0.1)
    assert gee.contrast(r, {"none": 1.0}) == (None, None, None)


def test_binomial_recovers_an_effect(spark):
    t = gee.simulated(spark, 600, effect=1.0, spread=0.3).where("complete = 0").withColumns({"fake": F.when(F.col("condition") == "fake", 1.0).otherwise(0.0), "dep": F.when(F.col("condition") == "dep", 1.0).otherwise(0.0)})
    d, names = design(t, ["fake", "dep"])
    r = gee.fit(d, "accept", names, "participant_id", True)
    assert r["status"] == "ok" and r["beta"][1] == pytest.approx(1.0, abs=0.25) and abs(r["beta"][2]) < 0.25
    assert gee.contrast(r, {"fake": 1.0})[2] > 4
    assert gee.fit(d.limit(0), "accept", names, "participant_id", True)["status"] == "no-data"
    twice, names = design(t.withColumn("also", F.col("fake")), ["fake", "also"])
    assert gee.fit(twice, "accept", names, "participant_id", True)["status"] == "singular"


def test_power_grows_with_the_effect(spark):
    got = {r["effect"]: r["power"] for r in gee.power(spark, [60], [0.0, 2.5], runs=2).collect()}
    assert got[2.5] == 1.0 and got[0.0] <= 0.5
    assert gee.simulated(spark, 6).groupBy("participant_id").count().where("count = 14").count() == 6
