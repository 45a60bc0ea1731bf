"""How dependent agents are: agreement beyond chance, intraclass correlation, effective number."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consensio.operators.labels import CELL, cell_measures, ratio
from consensio.schema import I_PERP


def fleiss_kappa(counts: DataFrame, by: Sequence[str], subject: Sequence[str]) -> DataFrame:
    """Fleiss' kappa of each group, its cells being subjects; I_perp is no category.

    Subjects of fewer than two ratings are dropped; NULL below two subjects or two categories; with
    complete chance agreement 1 if agreement is complete too, else NULL. The categories of a group are the labels that
    its items have anywhere in the table.
    """
    own = counts.where(F.col("label") != I_PERP)
    per = own.groupBy(*by, *subject).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    valid = per.where("m >= 2")
    p_o = valid.groupBy(*by).agg(F.avg(F.col("pairs") / (F.col("m") * (F.col("m") - 1))).alias("p_o"), F.count(F.lit(1)).alias("subjects"), F.sum("m").alias("ratings"))
    keys = [*by, *subject]
    same = None
    left, right = own.alias("l"), valid.select(*keys).alias("r")
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = c if same is None else same & c
    shares = left.join(right, same, "left_semi").groupBy(*by, "label").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    # categories: labels of the group's items over the whole table
    item = own.select("task", "label").distinct()
    members = counts.select(*by, "task").distinct()
    cats = members.join(item, "task").groupBy(*by).agg(F.countDistinct("label").alias("categories"))
    out = _join(_join(p_o, shares, by), cats, by)
    p_e = F.col("squares") / (F.col("ratings") * F.col("ratings"))
    k = F.when(F.abs(1 - p_e) < 1e-12, F.when(F.abs(F.col("p_o") - 1) < 1e-12, 1.0)).otherwise((F.col("p_o") - p_e) / F.nullif(1 - p_e, F.lit(0.0)))
    return out.select(*by, "subjects", F.when((F.col("subjects") >= 2) & (F.col("categories") >= 2), k).alias("kappa"))


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equi-join in which null keys match."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = None
    for k in by:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = c if on is None else on & c
    return a.join(b, on).drop(*[f"_r_{k}" for k in by])


def icc(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-way intraclass correlation of the wrong indicator over cells of each group; cells need n_agents and n_wrong.

    With the harmonic group size; NULL below two cells, without within-cell freedom, or where nothing varies.
    """
    n, w = F.col("n_agents").cast("double"), F.col("n_wrong").cast("double")
    g = cells.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(n).alias("N"), F.sum(w).alias("S"), F.sum(w * w / n).alias("Q"), F.sum(1 / n).alias("inv"))
    ms_b = F.try_divide(F.col("Q") - F.col("S") * F.col("S") / F.col("N"), F.col("k") - 1)
    ms_w = F.try_divide(F.col("S") - F.col("Q"), F.col("N") - F.col("k"))
    n0 = F.col("k") / F.col("inv")
    return g.select(*by, F.col("k").cast("bigint").alias("n_cells"), F.when(F.col("k") >= 2, F.try_divide(ms_b - ms_w, F.nullif(ms_b + (n0 - 1) * ms_w, F.lit(0.0)))).alias("icc"), (F.col("N") / F.col("k")).alias("mean_agents"))


def effective_size(n: Column, rho: Column) -> Column:
    """n / (1 + (n - 1) rho); n where that has no sense."""
    d = 1 + (n - 1) * rho
    return F.when(rho.isNull(), None).when((n <= 1) | (d <= 0), n.cast("double")).otherwise(n / F.nullif(d, F.lit(0.0)))


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Correlation from sums; NULL where either side does not vary."""
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 0) & (vy > 0), (n * xy - x * y) / F.sqrt(vx * vy))


def marginal_rho(errors: DataFrame, agent: str, item: str, error: str) -> DataFrame:
    """Mean correlation of the errors of two agents over the items both have; pairs that do not vary are skipped, none gives 0.

    Agents are a roster, not rows: an item is folded to one array of (agent, mean error) first, so the pairs
    made of it are those of the roster, whatever the number of rows.
    """
    per = errors.groupBy(item, agent).agg(F.avg(error).alias("e"))
    one = per.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(agent, "e"))).alias("a"))
    two = one.select(F.explode("a").alias("x"), "a").select("x", F.explode(F.filter("a", lambda z: z[agent] > F.col("x")[agent])).alias("y"))
    x, y = F.col("x.e"), F.col("y.e")
    sums = two.groupBy(F.col(f"x.{agent}").alias("a1"), F.col(f"y.{agent}").alias("a2")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    r = sums.select(pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("r"))
    return r.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("rho"), F.count("r").alias("n_pairs"))


def dependence_cells(counts: DataFrame) -> DataFrame:
    """Cells (see labels.CELL) with cd_primary, their agreement on wrong labels and the kappa of their method, model class and seed."""
    by = ["method", "model_class", "seed"]
    kappa = fleiss_kappa(counts, by, ["task", "regime", "ambiguity_k"]).select(*by, "kappa")
    own = cell_measures(counts, CELL).select(*CELL, "n_agents", "cd_primary", "pairwise_wrong")
    b = kappa.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return own.join(b, on, "left").drop(*[f"_r_{k}" for k in by])


def dependence_summary(counts: DataFrame, by: str = "regime") -> DataFrame:
    """by, n_cells, icc and n_eff: the intraclass correlation of each target's cells, averaged over the targets, and the effective number of agents."""
    own = cell_measures(counts, [*CELL, "target"]).withColumn("n_wrong", F.col("n_agents") - F.col("n_target"))
    per = icc(own, [by, "target"])
    out = per.groupBy(by).agg(F.sum("n_cells").alias("n_cells"), F.avg("icc").alias("icc"), (F.sum(F.col("mean_agents") * F.col("n_cells")) / F.sum("n_cells")).alias("_mean"))
    return out.select(by, "n_cells", "icc", effective_size(F.bround("_mean", 0), F.col("icc")).alias("n_eff"))
