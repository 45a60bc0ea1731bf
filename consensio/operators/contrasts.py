"""Comparisons of methods, regimes and ambiguity levels over cells."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.operators.durable import cut
from consensio.operators.labels import MEASURES, ratio
from consensio.operators.resample import index_ci, resampled_means


def mean_by(cells: DataFrame, by: Sequence[str], measures: Sequence[str] = ("cd_primary",), count: str | None = "n_cells") -> DataFrame:
    """Means of measures over the cells of each group; null keys are groups."""
    return cells.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures], *([F.count(F.lit(1)).alias(count)] if count else []))


def against_single(cells: DataFrame, single: str = "single", regime: str | None = "H1_external", measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """Each aggregation method's means and their differences to those of `single`; one pass, one small window."""
    own = cells.where(F.col("regime") == regime) if regime else cells
    by = own.groupBy("method").agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("n_cells"))
    # one row for each method
    base = {m: F.max(F.when(F.col("method") == single, F.col(m))).over(W.partitionBy()) for m in measures}
    return by.select("*", *[(F.col(m) - base[m]).alias(f"{m}_delta") for m in measures]).where(F.col("method") != single)


def method_contrast(cells: DataFrame, a: str, b: str, measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """Means over methods whose names begin with a, and with b, and their differences; one row."""
    one = [F.avg(F.when(F.col("method").startswith(p), F.col(m))).alias(f"{m}_{s}") for m in measures for p, s in ((a, "a"), (b, "b"))]
    return cells.agg(*one).select("*", *[(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_delta") for m in measures])


def heatmap(cells: DataFrame, row: str, column: str, values: Sequence[int], measure: str = "cd_primary") -> DataFrame:
    """Means of a measure with a column for each of the named values."""
    return cells.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(measure))).alias(f"k{v}") for v in values])


def mean_and_error(cells: DataFrame, by: Sequence[str], measure: str = "cd_primary") -> DataFrame:
    """Mean and standard error; the error is NULL for one cell."""
    return cells.groupBy(*by).agg(F.avg(measure).alias("mean"), ratio(F.stddev_samp(measure), F.sqrt(F.count(measure).cast("double"))).alias("se"), F.count(measure).alias("n"))


def with_zero(means: DataFrame, by: str, level: str, measure: str) -> DataFrame:
    """means (by, level, measure) with `synthetic`: a point of 0 at level 0 is added to a group that has none there."""
    groups = means.groupBy(by).agg(F.count_if(F.col(level) == 0).alias("_n")).where("_n = 0")
    zero = groups.select(by, F.lit(0).cast(means.schema[level].dataType).alias(level), F.lit(0.0).alias(measure), F.lit(True).alias("synthetic"))
    return means.select(by, level, measure, F.lit(False).alias("synthetic")).unionByName(zero)


def paired_delta(cells: DataFrame, a: str, b: str, measure: str = "cd_primary") -> DataFrame:
    """For each task with both methods, the mean of a less that of b."""
    x, y = (F.avg(F.when(F.col("method") == m, F.col(measure))) for m in (a, b))
    return cells.where(F.col("method").isin(a, b)).groupBy("task").agg(x.alias("mean_a"), y.alias("mean_b")).dropna().withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def with_pooled(rows: DataFrame, column: str, pooled: str = "POOLED") -> DataFrame:
    """rows twice: under their own value and under `pooled`, so that pooled groups are aggregated anew."""
    return rows.withColumn(column, F.explode(F.array(F.col(column), F.lit(pooled))))


def run_contrasts(new: DataFrame, base: DataFrame, configs: Sequence[str], baseline: str, b: int = 2000, seed: int = 42, regimes: Sequence[str] = ("H1_external", "H2_derivable"), measure: str = "cd_primary") -> DataFrame:
    """Each config of one run's cells against the baseline method of another's, by regime: means, and the mean difference over items that both have, with its interval.

    A row for each config and regime, with NULLs where there is nothing to compare. Items are few; nothing else is joined.
    """
    def items(own: DataFrame, methods: Sequence[str]) -> DataFrame:
        return own.where(F.col("method").isin(list(methods)) & F.col("regime").isin(list(regimes))).groupBy("task", "regime", F.col("method").alias("config")).agg(F.avg(measure).alias("v"))

    a, c = items(new, configs), items(base, [baseline]).select("task", "regime", F.col("v").alias("other"))
    pairs = cut(a.join(c, ["task", "regime"]).withColumn("delta", F.col("v") - F.col("other")))
    grid = new.sparkSession.createDataFrame([(x, r) for x in configs for r in regimes], "config string, regime string")
    own = a.groupBy("config", "regime").agg(F.count(F.lit(1)).alias("n_items"), F.avg("v").alias("mean_cd"))
    other = c.groupBy("regime").agg(F.avg("other").alias("baseline_cd"))
    delta = pairs.groupBy("config", "regime").agg(F.count(F.lit(1)).alias("n_delta"), F.avg("delta").alias("delta"))
    ci = index_ci(resampled_means(pairs, "task", "delta", b, seed, ["config", "regime"]), "mean", ["config", "regime"])
    out = grid.join(own, ["config", "regime"], "left").join(other, "regime", "left").join(delta, ["config", "regime"], "left").join(ci, ["config", "regime"], "left")
    return out.fillna(0, ["n_items", "n_delta"])
