"""All verdicts of a study from one tidy table, and the gate that a pilot must pass."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensio.operators import decide as V
from consensio.operators import linear as L
from consensio.operators import nulls as N
from consensio.operators import resample as R
from consensio.operators.durable import cut
from consensio.operators.labels import CELL, cell_measures, cells, label_counts

#: Conditions within which labels may be shuffled.
CONDITION = ["regime", "method", "model", "ambiguity_k"]
_CI = "hypothesis string, point double, lo double, hi double, status string"


def against_single_replicates(counts: DataFrame, keys: Sequence[str], b: int, seed: int, how: str = "two-way", measure: str = "cd_primary") -> DataFrame:
    """b, d: means over cells of aggregating methods less those of `single`, in replicates (see resample.cell_replicates)."""
    own = counts.withColumn("single", F.col("method") == "single")
    reps = R.cell_replicates(own, [*keys, "single"], ["single"], b, seed, how, measure)
    return reps.groupBy("b").agg((F.max(F.when(~F.col("single"), F.col("mean"))) - F.max(F.when(F.col("single"), F.col("mean")))).alias("d"))


def _point(own: DataFrame, measure: str) -> DataFrame:
    single = F.col("method") == "single"
    return own.agg((F.avg(F.when(~single, F.col(measure))) - F.avg(F.when(single, F.col(measure)))).alias("point"))


def _aggregation(t: DataFrame, name: str, status: str, b: int, seed: int, measure: str) -> DataFrame:
    counts = cut(label_counts(t, [*CELL, "model"]))
    whole = cell_measures(counts.groupBy(*CELL, "target", "label").agg(F.sum("n").alias("n")), CELL)
    ci = R.percentile_ci(against_single_replicates(counts, CELL, b, seed, "two-way", measure), "d")
    ok = F.when(F.col("lo").isNull(), "no_data").otherwise(status)
    return R._one(_point(whole, measure), ci).select(F.lit(name).alias("hypothesis"), "point", "lo", "hi", ok.alias("status"))


def _beyond_shuffle(t: DataFrame, b: int, n_perm: int, seed: int, measure: str) -> DataFrame:
    """What agreement is beyond shuffled labels, cell by cell, with tasks and models weighted in replicates."""
    keys = ["task", *CONDITION]
    counts = cut(label_counts(t, keys))
    real = cell_measures(counts, keys).select(*keys, F.col(measure).alias("real"))
    null = N.shuffled(counts, keys, CONDITION, keys, n_perm, seed, measure, expected=True)
    gaps = N.null_safe_join(real, null, keys).select(F.col("task").alias("_t"), F.col("model").alias("_m"), (F.col("real") - F.col("mean")).alias("_v"))

    def fold(pdf):
        for task, model, v in zip(pdf["_t"], pdf["_m"], pdf["_v"]):
            w = R.weights(seed, task, b).astype(float) * R.weights(seed + 1, model, b)
            yield (), (w, w * v)

    gaps = cut(gaps)
    reps = R._sums(gaps, [], fold, ["w", "s"]).select("b", F.try_divide("s", F.nullif("w", F.lit(0.0))).alias("d"))
    return R._one(gaps.agg(F.avg("_v").alias("point")), R.percentile_ci(reps, "d")).select(F.lit("R1").alias("hypothesis"), "point", "lo", "hi", F.lit("ok").alias("status"))


def item_cells(t: DataFrame, measure: str) -> DataFrame:
    """Cells of the item-level model: task, method, model_class, regime, ambiguity_k and the mean measure over seeds."""
    return cells(t).groupBy("task", "method", "model_class", "regime", "ambiguity_k").agg(F.avg(measure).alias("y"))


def evaluate(tidy: DataFrame, measure: str = "cd_primary", b: int = 500, seed: int = 7, n_perm: int = 200, reasoning: str = "reasoning") -> DataFrame:
    """hypothesis, point, lo, hi, status, verdict of H1a, H1b, H2 (its interaction and its contrast), R1 and R2.

    H1a: aggregation against single answers over external tasks. H1b: slope of the measure on the ambiguity level. H2: interaction of
    derivable tasks with reasoning models, refuted if reasoning aggregation lies above single answers. R1: agreement
    beyond labels shuffled within conditions, with a fifth of the replicates, 80 at least. R2: H1a where another family built the
    task. Rows without a model or a method are left out of replicates of models. What cannot be computed is INCONCLUSIVE.
    """
    spark = tidy.sparkSession
    own = tidy.where("model IS NOT NULL AND method IS NOT NULL")
    h1 = own.where("regime = 'H1_external'")
    cross = h1.where("family <> constructor_family")
    unknown = h1.where("family IS NULL OR constructor_family IS NULL").limit(1).count()
    reasoner = own.where((F.col("regime") == "H2_derivable") & (F.col("model_class") == reasoning))

    y = cut(item_cells(tidy, measure))
    external = y.where("regime = 'H1_external'")
    d, names = L.design(external, ["ambiguity_k"], {f: sorted(r[0] for r in external.select(f).dropna().distinct().collect()) for f in L.varying(external, ["method", "model_class"])})
    slope = L.interval(L.fit(d, "y", names, "task"), "ambiguity_k")
    tagged = y.where("regime IS NOT NULL")
    classes = sorted((r[0] for r in tagged.select("model_class").dropna().distinct().collect()), key=lambda c: (c == reasoning, c))
    regimes = ["H1_external", "H2_derivable"]
    d, names = L.design(tagged, ["ambiguity_k"], {"regime": regimes, "model_class": classes, "method": sorted(r[0] for r in tagged.select("method").dropna().distinct().collect())}, [("regime", "model_class")])
    term = L.interval(L.fit(d, "y", names, "task"), f"regime[H2_derivable]:model_class[{reasoning}]") if len(classes) > 1 else (None, None, None, "degenerate")
    rows = spark.createDataFrame([("H1b", *slope), ("H2_interaction", *term)], _CI)
    for part in (
        _aggregation(h1, "H1a", "ok", b, seed, measure),
        _aggregation(cross, "R2", "incomplete_family_map" if unknown else "ok", b, seed, measure),
        _aggregation(reasoner, "H2_reasoner_vs_single", "ok", b, seed, measure),
        _beyond_shuffle(h1, max(80, b // 5), n_perm, seed, measure),
    ):
        rows = rows.unionByName(part)
    rows = cut(rows)
    lo, hi = F.col("lo"), F.col("hi")
    single = rows.where(~F.col("hypothesis").startswith("H2_")).withColumn("verdict", F.when(F.col("hypothesis") == "H1a", V.verdict(lo, hi, at_least_zero=True)).otherwise(V.verdict(lo, hi)))
    parts = rows.groupBy().pivot("hypothesis", ["H2_interaction", "H2_reasoner_vs_single"]).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    h2 = rows.where(F.col("hypothesis").startswith("H2_")).join(F.broadcast(parts)).withColumn("verdict", V.verdict_h2(F.col("H2_interaction_lo"), F.col("H2_interaction_hi"), F.col("H2_reasoner_vs_single_lo")))
    return single.unionByName(h2.select(*single.columns))


def pilot_gate(tidy: DataFrame, n_interpretations: str = "n_interpretations", b: int = 2000, n_perm: int = 200, seed: int = 42, tolerance: float = 0.05, margin: float = 0.05, least: int = 5) -> DataFrame:
    """One row for each check of a pilot: check, value, lo, hi, passed; NULL where it cannot be decided.

    golden: two labels I1 of two I_perp and one I1 give the known measure. cardinality: every task has the interpretations that its
    ambiguity level opens (2 ** k). R1a: external tasks of k >= 1 are above those of k = 0, with an interval above 0. R1b: agreement at k
    >= 1 is above agents that answer at random by `margin`, over at least `least` items. degenerate: the share of I_perp is at most `tolerance`.
    """
    spark = tidy.sparkSession
    golden = float(R.measure_of(np.array([[2.0, 3.0]]), ["I1", "I_perp"], "I0")[0])
    counts = cut(label_counts(tidy, [*CELL, n_interpretations]))
    whole = cut(cell_measures(counts, [*CELL, n_interpretations]))
    h1 = whole.where("regime = 'H1_external'")
    k1 = F.col("ambiguity_k") >= 1
    per = h1.groupBy("task", F.when(k1, "k1").otherwise("k0").alias("side")).agg(F.avg("cd_primary").alias("v"))
    contrast = R.signed_ci(per, "task", "v", "side", {"k1": 1, "k0": -1}, b, seed)
    a = contrast.select(F.lit("R1a").alias("check"), F.col("point").alias("value"), "lo", "hi", (F.col("lo") > 0).alias("passed"))
    own = counts.where("regime = 'H1_external'").where(k1)
    keys = [*CELL, n_interpretations]
    g = N.gap(own, keys, N.uniform(own, keys, n_interpretations, ["regime"], n_perm, seed), ["regime"])
    r1b = g.select(F.lit("R1b").alias("check"), F.col("delta").alias("value"), "lo", "hi", F.when(F.col("n_cells") >= least, F.col("delta") > margin).alias("passed"))
    sized = whole.select("task", n_interpretations, "ambiguity_k").distinct()
    fits_k = F.col(n_interpretations) == F.pow(F.lit(2), F.col("ambiguity_k"))
    none = F.lit(None).cast("double")
    card = sized.agg(F.avg(fits_k.cast("double")).alias("value")).select(F.lit("cardinality").alias("check"), "value", none.alias("lo"), none.alias("hi"), (F.col("value") == 1.0).alias("passed"))
    perp = whole.agg((F.sum("n_perp") / F.sum("n_agents")).alias("value")).select(F.lit("degenerate").alias("check"), "value", none.alias("lo"), none.alias("hi"), (F.col("value") <= tolerance).alias("passed"))
    gold = spark.createDataFrame([("golden", golden, None, None, golden == 0.4)], "check string, value double, lo double, hi double, passed boolean")
    return gold.unionByName(card).unionByName(a).unionByName(r1b).unionByName(perp)
