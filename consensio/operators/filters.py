"""Which runs count: methods, seeds, and families that are kept apart."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_methods(tidy: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Rows of the named methods; a null method is none of them."""
    return tidy.where(F.col("method").isin(list(methods)))


def of_seeds(tidy: DataFrame, seeds: Sequence[int] | None) -> DataFrame:
    """Rows of the seeds that a manifest asks for (see runlog.requested_seeds); None keeps all."""
    return tidy if seeds is None else tidy.where(F.col("seed").isin(list(seeds)))


def held_out(family: str = "family", constructor: str = "constructor_family") -> Column:
    """Whether the tested model is of the family that built its task; unknown families are not."""
    return F.coalesce(F.col(family) == F.col(constructor), F.lit(False))


def hold_out(tidy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without those whose family built the task, and the number of kept and dropped ones (one row)."""
    return tidy.where(~held_out()), tidy.agg(F.count_if(~held_out()).alias("n_kept"), F.count_if(held_out()).alias("n_dropped"))


def refuse_shared_families(tested: Mapping[str, Sequence[str]], apart: Mapping[str, str]) -> None:
    """Raise if the family of a role in `apart` (constructor, judge) is that of a tested group; roles may share one."""
    for role, family in apart.items():
        groups = sorted(g for g, own in tested.items() if family in own)
        if groups:
            raise ValueError(f"the {role} is of family {family!r}, which is tested in {groups}")
