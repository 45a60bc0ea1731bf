"""Divergence of labels as a signal that a task is underdetermined."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.operators.durable import cut
from consensio.operators.labels import cell_measures, label_counts, modal_label
from consensio.operators.order import null_safe_join, parts_of, running_sums

MIN_MINORITY = 0.34
WEIGHTS = (0.5, 0.25, 0.25)
FIRE = 0.3


def robust(minority: Column, divergence: Column, least: float = MIN_MINORITY) -> Column:
    """Divergence, 0 where the minority is too small to be more than noise."""
    return F.when(minority < least, 0.0).otherwise(divergence)


def surfacing(tidy: DataFrame, questions: DataFrame | None = None, least: float = MIN_MINORITY, weights: tuple[float, float, float] = WEIGHTS, fire: float = FIRE) -> DataFrame:
    """Score of each task from three signals, renormalised over those there are.

    s_div: over all agents; s_inst: mean over models with two or more enumerated samples; s_cross: over the modal
    labels of families, of which two are needed. NULL signals are left out. fired: score >= fire. With
    questions (task, key_questions), axes are those of a fired task where any signal diverges.
    """
    counts = label_counts(tidy.select("task", "model", "family", "target", "label"), ["task", "model", "family"])
    whole = cell_measures(counts.groupBy("task", "target", "label").agg(F.sum("n").alias("n")), ["task"])
    whole = whole.select("task", "n_agents", "n_perp", "k_enumerated", robust(F.col("minority"), F.col("divergence"), least).alias("s_div"))
    model = cell_measures(counts.where(F.col("model").isNotNull()).groupBy("task", "model", "target", "label").agg(F.sum("n").alias("n")), ["task", "model"]).where("n_enumerated >= 2")
    inst = model.groupBy("task").agg(F.avg(robust(F.col("minority"), F.col("divergence"), least)).alias("s_inst"))
    modal = modal_label(counts.where(F.col("family").isNotNull()), ["task", "family"]).withColumn("target", F.lit("")).groupBy("task", "target", "label").agg(F.count(F.lit(1)).alias("n"))
    cross = cell_measures(modal, ["task"]).where("n_agents >= 2").select("task", robust(F.col("minority"), F.col("divergence"), least).alias("s_cross"))
    out = whole.join(inst, "task", "left").join(cross, "task", "left")
    a, b, c = weights
    num = a * F.col("s_div") + b * F.coalesce("s_inst", F.lit(0.0)) + c * F.coalesce("s_cross", F.lit(0.0))
    den = a + F.when(F.col("s_inst").isNotNull(), b).otherwise(0.0) + F.when(F.col("s_cross").isNotNull(), c).otherwise(0.0)
    out = out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den)), 9)).withColumn("fired", F.col("score") >= fire)
    if questions is None:
        return out
    diverges = (F.col("k_enumerated") >= 2) | F.coalesce(F.col("s_inst") > 0, F.lit(False)) | F.coalesce(F.col("s_cross") > 0, F.lit(False))
    none = F.array().cast("array<string>")
    return out.join(questions.select("task", "key_questions"), "task", "left").withColumn("axes", F.when(F.col("fired") & diverges, F.coalesce("key_questions", none)).otherwise(none)).drop("key_questions")


def tolerance_clusters(rows: DataFrame, by: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """rows with `cluster`: components of values that lie within tolerance of a neighbour, numbered upwards in each group.

    Equality within a tolerance is not transitive; on a line its components end at gaps, so values are folded to distinct
    ones and sorted in ranges instead of compared in pairs; a range's first value is compared with the last one of the
    range before. Null values are left out.
    """
    own = rows.where(F.col(value).isNotNull())
    per = cut(parts_of(own.select(*by, value).distinct(), value))
    ends = per.groupBy(*by, "_part").agg(F.max(value).alias("_max"))
    ends = ends.select(*by, "_part", F.lag("_max").over(W.partitionBy(*by).orderBy("_part")).alias("_last"))
    per = null_safe_join(per, ends, [*by, "_part"])
    before = F.coalesce(F.lag(value).over(W.partitionBy(*by, "_part").orderBy(value)), "_last")
    per = per.withColumn("_new", F.when(F.col(value) - before < tolerance, 0).otherwise(1)).drop("_part", "_last")
    per = running_sums(per, by, value, {"_c": "_new"}).select(*by, value, (F.col("_c") + F.col("_new")).alias("cluster"))
    per = per.withColumnsRenamed({value: "_v"})
    return null_safe_join(own.withColumn("_v", F.col(value)), per, [*by, "_v"]).drop("_v")


def cluster_entropy(answers: DataFrame, by: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """by, n_parsed, n_clusters and the entropy in bits over tolerance clusters of the answers that parsed; 0 below two of them."""
    n = answers.groupBy(*by).agg(F.count(value).alias("n_parsed"))
    c = tolerance_clusters(answers, by, value, tolerance).groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("k"))
    bits = F.log2(F.sum("k").cast("double")) - F.sum(F.col("k") * F.log2(F.col("k").cast("double"))) / F.sum("k")
    e = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.abs(bits).alias("h_ctx"))
    out = null_safe_join(n, e, by, "left")
    return out.select(*by, "n_parsed", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), F.coalesce("h_ctx", F.lit(0.0)).alias("h_ctx"))


def context_entropy(answers: DataFrame, item: list[str], dimension: str, place: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """item, h_ctx_max, flagged_dimension, n_pins, n_parsed: how far pinning some dimension changes an item's answer.

    answers: item, dimension, its place among the item's dimensions, value (null: not parsed). The dimension of the
    largest entropy is flagged, the first of equal ones; none where nothing changes the answer.
    """
    per = cluster_entropy(answers, [*item, dimension], value, tolerance)
    places = answers.groupBy(*item, dimension).agg(F.min(place).alias("_place"), F.count(F.lit(1)).alias("n_pins"))
    per = null_safe_join(per, places, [*item, dimension])
    # entropies are rounded, as equal ones may differ in their last digit
    best = F.max_by(F.struct(F.col("h_ctx").alias("h"), F.col(dimension).alias("d")), F.struct(F.round("h_ctx", 9), -F.col("_place")))
    out = per.groupBy(*item).agg(best.alias("b"), F.sum("n_pins").alias("n_pins"), F.sum("n_parsed").alias("n_parsed"))
    return out.select(*item, F.col("b.h").alias("h_ctx_max"), F.when(F.col("b.h") > 0, F.col("b.d")).alias("flagged_dimension"), "n_pins", "n_parsed")


def danger(h_ctx: Column, h_seed: Column, tau: float = 0.0, tau_seed: float = 0.5) -> Column:
    """Whether an answer depends on an unstated dimension and yet looks certain; unknown signals do not."""
    return F.coalesce((h_ctx > tau) & (h_seed <= tau_seed), F.lit(False))


def baseline_scores(h_seed: Column, logprob_confidence: Column, consistency: Column, n_dimensions: Column) -> list[Column]:
    """The scores a detector is compared with, larger for more ambiguous: seed entropy, token uncertainty, disagreement, dimensions named."""
    return [h_seed.alias("seed_entropy"), (1 - logprob_confidence).alias("token_logprob"), (1 - consistency).alias("self_consistency"), F.coalesce(n_dimensions, F.lit(0)).cast("double").alias("requirements_probing")]
