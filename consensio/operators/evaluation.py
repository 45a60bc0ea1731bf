"""Scores against truth: ranks, areas, thresholds, calibration, agreement of coders, population estimates."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.functions.text import mask_labels
from consensio.operators.durable import cut, fits, hot_keys, salted_join
from consensio.operators.labels import ratio
from consensio.operators.order import null_safe_join, running_sums


def auroc(rows: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the curve for each group: wins of positives over negatives, ties half; NULL without both classes.

    Rows are first folded to one row for each distinct score, and ranks are running sums over ranges of those, so no task
    orders all scores of a group. Null scores are left out.
    """
    per = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    per = running_sums(per, by, score, {"below": "q"}).withColumn("wins", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return per.groupBy(*by).agg(F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), ratio(F.sum("wins"), F.sum("p") * F.sum("q")).alias("auroc"))


def confusion(rows: DataFrame, predicted: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall and F1 (0 where undefined) and their variants that are NULL where undefined."""
    a, b = F.coalesce(F.col(predicted), F.lit(False)), F.col(positive)
    tp, fp, fn, tn = F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)
    out = rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision_or_null", p).withColumn("recall_or_null", r)
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)))


def detector_report(items: DataFrame, score: str, fired: str, positive: str, control: str, groups: Sequence[str]) -> DataFrame:
    """dim, value, n, false_rate over controls, auroc, precision, recall and f1: over all items ('all') and by each of the groups; null values are groups.

    Items are repeated once for each grouping, and every number follows from one pass over (group, score).
    """
    each = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(g).alias("dim"), F.col(g).cast("string").alias("value")) for g in groups])
    own = cut(items.select(F.explode(each).alias("g"), F.col(score).alias("s"), F.col(fired).alias("f"), F.col(positive).alias("p"), F.col(control).alias("c")).select("g.*", "s", "f", "p", "c"))
    by = ["dim", "value"]
    false_rate = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("c") & F.col("f")), F.count_if("c")).alias("false_rate"))
    out = null_safe_join(false_rate, confusion(own, "f", "p", by).select(*by, "precision", "recall", "f1"), by)
    return null_safe_join(out, auroc(own, "s", "p", by).select(*by, "auroc"), by, "left")


def calibration(rows: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence, the last one closed: bin, n, mean confidence, accuracy. Null confidences are left out."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(conf).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def ece(binned: DataFrame) -> DataFrame:
    return binned.agg(ratio(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def slope(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope of y on x, 0 where x does not vary."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    y = F.col(y).cast("double")
    return own.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0))), F.lit(0.0)).alias("slope"), F.count(F.lit(1)).alias("n"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa of two binary coders; NULL where chance agreement is complete."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    n = F.count(F.lit(1)).cast("double")
    po, pa, pb = F.count_if(x == y) / n, F.sum(x) / n, F.sum(y) / n
    out = pairs.dropna(subset=[a, b]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), po.alias("po"), (pa * pb + (1 - pa) * (1 - pb)).alias("pe"))
    return out.withColumn("kappa", F.when(F.col("pe") < 1 - 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def two_coders(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """key, a, b: the labels of two coders for what both have coded; a key is coded once by each."""
    return first.select(key, F.col(label).alias("a")).join(second.select(key, F.col(label).alias("b")), key)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; NULL at n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def population(sample: DataFrame, stratum: str, size: str, predicted: str, human: str, z: float = 1.959963984540054) -> DataFrame:
    """Estimates for the population from a stratified sample, each row weighted by its stratum's size over its rows.

    Returns weighted counts, precision, recall, F1, the rate of `human` and its interval with the finite
    population correction; NULL where undefined, and F1 is 0 where both are 0.
    """
    d, h = F.col(predicted), F.col(human)
    g = sample.groupBy(stratum).agg(F.max(size).cast("double").alias("size"), F.count(F.lit(1)).cast("double").alias("n"), F.count_if(h).alias("h1"), F.count_if(d & h).alias("tp"), F.count_if(d & ~h).alias("fp"), F.count_if(~d & h).alias("fn"), F.count_if(~d & ~h).alias("tn"))
    w, p = F.col("size") / F.col("n"), F.col("h1") / F.col("n")
    var = F.when(F.col("n") > 1, F.pow("size", F.lit(2)) * (1 - F.col("n") / F.col("size")) * p * (1 - p) / (F.col("n") - 1)).otherwise(0.0)
    out = g.agg(*[F.sum(F.col(c) * w).alias(f"{c}_pop") for c in ("tp", "fp", "fn", "tn")], F.sum("size").alias("n_total"), ratio(F.sum(F.col("size") * p), F.sum("size")).alias("rate"), F.sqrt(ratio(F.sum(var), F.pow(F.sum("size"), F.lit(2)))).alias("se"))
    pr, rc = ratio(F.col("tp_pop"), F.col("tp_pop") + F.col("fp_pop")), ratio(F.col("tp_pop"), F.col("tp_pop") + F.col("fn_pop"))
    f1 = F.when(pr + rc == 0, 0.0).otherwise(F.try_divide(2 * pr * rc, pr + rc))
    return out.withColumns({"precision": pr, "recall": rc, "f1": f1, "rate_lo": F.greatest(F.lit(0.0), F.col("rate") - z * F.col("se")), "rate_hi": F.least(F.lit(1.0), F.col("rate") + z * F.col("se"))}).drop("se")


def threshold(items: DataFrame, score: str, control: str, positive: str, target: float = 0.1, eps: float = 1e-9) -> DataFrame:
    """The lowest threshold of most recall among those at which fewer than `target` of the controls fire.

    Candidates are 0, the scores, just above each score, and just above 1, at which nothing fires. Rows are
    folded to distinct scores first. One row; no items: the threshold at which nothing fires.
    """
    per = items.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(control).alias("c"), F.count_if(positive).alias("p"))
    per = per.withColumn("down", -F.col("s"))
    per = running_sums(per, [], "down", {"c_above": "c", "p_above": "p"}).withColumns({"c_ge": F.col("c_above") + F.col("c"), "p_ge": F.col("p_above") + F.col("p")})
    per = cut(per)  # four uses follow
    per = per.select(F.explode(F.array(F.struct(F.col("s").alias("t"), F.col("c_ge").alias("c"), F.col("p_ge").alias("p")), F.struct((F.col("s") + eps).alias("t"), (F.col("c_ge") - F.col("c")).alias("c"), (F.col("p_ge") - F.col("p")).alias("p")))).alias("x"), "c_ge", "p_ge").select("x.*", "c_ge", "p_ge")
    n = per.agg(F.coalesce(F.max("c_ge"), F.lit(0)).alias("c"), F.coalesce(F.max("p_ge"), F.lit(0)).alias("p"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0.0).alias("t"), "c", "p"), F.struct(F.lit(1.0 + eps).alias("t"), F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("p")))).alias("x")).select("x.*")
    totals = n.select(F.lit(1).alias("_one"), F.col("c").alias("n_c"), F.col("p").alias("n_p"))
    all_of = per.select("t", "c", "p").unionByName(ends).withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").drop("_one")
    ok = all_of.where(F.coalesce(ratio(F.col("c"), F.col("n_c")), F.lit(0.0)) < target).where(F.col("t") <= 1.0 + eps)
    best = F.min(F.struct((-F.round(F.coalesce(ratio(F.col("p"), F.col("n_p")), F.lit(0.0)), 12)).alias("r"), "t", F.coalesce(ratio(F.col("c"), F.col("n_c")), F.lit(0.0)).alias("f")))
    return ok.agg(best.alias("b")).select(F.col("b.t").alias("threshold"), (-F.col("b.r")).alias("recall"), F.col("b.f").alias("false_rate"))


def mid_rank(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with the mean rank of their ties and, from the top, the smallest rank of their ties; null values are left out.

    Ranks are taken over distinct values and joined back, broadcast where they are few, else with hot ties salted.
    """
    per = cut(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
    total = per.groupBy(*by).agg(F.sum("_n").alias("_all"))
    own = running_sums(per, by, value, {"_below": "_n"})
    own = null_safe_join(own, total, by) if by else own.join(F.broadcast(total))
    own = own.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("mid_rank"), (F.col("_all") - F.col("_below") - F.col("_n") + 1).alias("competition_rank"))
    if fits(per):
        return rows.join(F.broadcast(own), [*by, value])
    return salted_join(rows, own, [*by, value], hot_keys(rows, [*by, value]))


def signal_sample(rows: DataFrame, signal: str, uid: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows for coding: an equal share of each signal (at least one), and the rest from the rows not taken; all of them if there are fewer.

    Rows are ordered by a hash of their unique id, so the sample is the same at every partitioning. Only the first rows of
    each part of a signal are kept before they are ordered together.
    """
    own = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(uid).cast("string")))).withColumn("_p", F.pmod(F.crc32(F.col(uid).cast("string")), F.lit(64)))
    small = cut(own.withColumn("_k", F.row_number().over(W.partitionBy(signal, "_p").orderBy("_h", uid))).where(F.col("_k") <= size))  # 64 * size rows of a signal at most
    share = max(1, size // max(1, small.agg(F.countDistinct(signal)).first()[0]))
    ranked = cut(small.withColumn("_k", F.row_number().over(W.partitionBy(signal).orderBy("_h", uid))))
    first = ranked.where(F.col("_k") <= share)
    rest = ranked.where(F.col("_k") > share).orderBy("_h", uid).limit(max(0, size - first.count()))
    return first.unionByName(rest).drop("_h", "_p", "_k")


def coding_rows(runs: DataFrame, tasks: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """runs (log_pos, task, output) with their task's domain and prompt for coders; labels are masked, null texts are ''."""
    t = tasks.dropna(subset=["task"]).dropDuplicates(["task"])
    both = runs.join(F.broadcast(t), "task", "left") if fits(tasks) else salted_join(runs, t, ["task"], hot_keys(runs, ["task"]), "left")
    none = F.lit("")
    return both.select("log_pos", F.coalesce("domain", F.lit(unknown)).alias("domain"), mask_labels(F.coalesce("prompt", none)).alias("task_prompt"), mask_labels(F.coalesce("output", none)).alias("model_output"))
