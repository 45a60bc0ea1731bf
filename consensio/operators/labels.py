"""Everything that follows from how many agents of a cell chose each label.

All measures are sums over the relation (cell, label, n): one aggregation folds agents, a second one folds
labels. Pairs of agents are never made.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consensio.schema import I_PERP

CELL = ["task", "method", "model_class", "seed", "regime", "ambiguity_k"]


def label_counts(tidy: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """keys, target, label, n. Null keys are kept as groups; null labels must have been dropped."""
    return tidy.groupBy(*keys, *[c for c in ("target",) if c not in keys], "label").agg(F.count(F.lit(1)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cell_measures(counts: DataFrame, keys: Sequence[str] = CELL, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Measures of each cell from its label counts; extra: further ones by name, as aggregates over the rows (target, label, n) of a cell.

    cd_frozen: share of the most frequent wrong label; cd_primary: the same without I_perp as a candidate;
    cd_drop_iperp: without I_perp at all, 0 if nothing is left; iperp_rate; a_maj: 1 if the target is the only
    mode; pairwise_wrong: pairs of enumerated wrong agents with the same label, NULL below two such agents;
    entropy: bits over all labels; entropy_norm: over the distinct labels present, in 0..1; consistency: share
    of the mode; minority: one less the share of the mode among enumerated labels; divergence: entropy_norm of
    the enumerated labels.
    """
    n, label = F.col("n"), F.col("label")
    wrong, perp = label != F.col("target"), label == I_PERP
    enum = wrong & ~perp
    total, n_perp = F.sum(n), F.sum(F.when(perp, n).otherwise(0))
    top_wrong = F.coalesce(F.max(F.when(enum, n)), F.lit(0))
    top_bad = F.coalesce(F.max(F.when(wrong, n)), F.lit(0))
    n_target = F.sum(F.when(~wrong, n).otherwise(0))
    n_enum_wrong = F.sum(F.when(enum, n).otherwise(0))
    bits = F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total
    n_enum, k_enum = total - n_perp, F.count(F.when(~perp, label))
    enum_bits = F.log2(F.nullif(n_enum, F.lit(0)).cast("double")) - ratio(F.sum(F.when(~perp, n * F.log2(n.cast("double"))).otherwise(0.0)), n_enum)
    return counts.groupBy(*keys).agg(
        total.alias("n_agents"),
        ratio(top_bad, total).alias("cd_frozen"),
        ratio(top_wrong, total).alias("cd_primary"),
        F.coalesce(ratio(top_wrong, n_enum), F.lit(0.0)).alias("cd_drop_iperp"),
        ratio(n_perp, total).alias("iperp_rate"),
        F.when(n_target > top_bad, 1).otherwise(0).alias("a_maj"),
        ratio(F.sum(F.when(enum, n * (n - 1)).otherwise(0)), n_enum_wrong * (n_enum_wrong - 1)).alias("pairwise_wrong"),
        bits.alias("entropy"),
        F.when(F.count(label) > 1, bits / F.log2(F.count(label).cast("double"))).otherwise(0.0).alias("entropy_norm"),
        ratio(F.max(n), total).alias("consistency"),
        F.when(k_enum > 1, 1 - ratio(F.max(F.when(~perp, n)), n_enum)).otherwise(0.0).alias("minority"),
        F.when(k_enum > 1, enum_bits / F.log2(k_enum.cast("double"))).otherwise(0.0).alias("divergence"),
        n_enum.alias("n_enumerated"),
        k_enum.alias("k_enumerated"),
        n_perp.alias("n_perp"),
        n_target.alias("n_target"),
        n_enum_wrong.alias("n_enum_wrong"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )


def cells(tidy: DataFrame, keys: Sequence[str] = CELL, extra: Mapping[str, Column] | None = None) -> DataFrame:
    return cell_measures(label_counts(tidy, keys), keys, extra)


#: Measures that may be chosen by name.
MEASURES = ["cd_primary", "cd_frozen", "cd_drop_iperp", "iperp_rate"]


def modal_wrong(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent enumerated wrong label of each group, ties to the smallest; groups without one are left out."""
    wrong = counts.where((F.col("label") != F.col("target")) & (F.col("label") != I_PERP))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("label").alias("label")))
    return wrong.groupBy(*keys, "label").agg(F.sum("n").alias("n")).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("foil"), (-F.col("b.neg")).alias("n_foil"))


def modal_label(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent enumerated label of each group, ties to the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("label").alias("label")))
    return counts.where(F.col("label") != I_PERP).groupBy(*keys, "label").agg(F.sum("n").alias("n")).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("label"))
