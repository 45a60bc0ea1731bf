"""Resampling queries are registered at the counts of the reference, and their intervals are no extremes."""

import re

import pytest
from pyspark.sql import functions as F

from consensio.operators import resample as R
from consensio.plans import catalogue, consensus

COUNTS = {"boot_mean_ci": 2000, "boot_diff_ci": 2000, "boot_interaction_ci": 2000, "auroc_boot": 2000, "cluster_boot_h1a": 500, "task_boot_h1a": 500}


@pytest.mark.parametrize("name", list(COUNTS))
def test_replicates_of_the_reference(name):
    # the queries are compared with this SQL, draw by draw
    assert set(re.findall(r"unnest\(range\((\d+)\)\)", catalogue.SQL[name])) == {str(COUNTS[name])}


def test_replicates_of_the_nulls():
    # of shuffle_null, uniform_null, indep_counterfactual, verdicts and gate, which no SQL repeats
    assert (consensus.B_ITEMS, consensus.B_VERDICT, consensus.B_NULL) == (2000, 500, 200)


def test_interval_leaves_tails_out(spark):
    reps = spark.range(COUNTS["boot_mean_ci"]).select(F.col("id").cast("double").alias("v"))
    r = R.index_ci(reps, "v").first()
    assert (r["lo"], r["hi"]) == (49.0, 1950.0)
