"""Checks of answers by name, and the labels that follow from them."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consensio.schema import I_PERP


class Checks:
    """Checks by domain and interpretation. A check takes the answer's column and gives a boolean; NULL does not pass."""

    def __init__(self):
        self.of: dict[str, dict[str, Callable[[Column], Column]]] = {}

    def add(self, domain: str, interpretation: str):
        """Register a check under a name that is not taken."""

        def put(check: Callable[[Column], Column]):
            own = self.of.setdefault(domain, {})
            if interpretation in own:
                raise ValueError(f"{domain} has a check of {interpretation}")
            own[interpretation] = check
            return check

        return put

    def passed(self, domain: str, answer: str) -> Column:
        """Interpretations that an answer passes, by its domain; none for a domain without checks."""
        out = F.array().cast("array<string>")
        for name, checks in self.of.items():
            each = F.array(*[F.when(F.coalesce(c(F.col(answer)), F.lit(False)), F.lit(i)) for i, c in sorted(checks.items())])
            out = F.when(F.col(domain) == name, F.filter(each, lambda x: x.isNotNull())).otherwise(out)
        return out


def label_of(passed: Column) -> Column:
    """The only interpretation passed, else I_perp."""
    return F.when(F.size(passed) == 1, F.get(passed, F.lit(0))).otherwise(I_PERP)


def agreed_label(labels: Column) -> Column:
    """The label that all blocks of an answer have; I_perp if they differ or there are none."""
    distinct = F.array_distinct(labels)
    return F.when(F.size(distinct) == 1, F.coalesce(F.get(distinct, F.lit(0)), F.lit(I_PERP))).otherwise(I_PERP)


def label_answers(rows: DataFrame, checks: Mapping | Checks, domain: str, answer: str) -> DataFrame:
    """rows with `passed` and `label`; no row is made for a check, so nothing is shuffled."""
    return rows.withColumn("passed", checks.passed(domain, answer)).withColumn("label", label_of(F.col("passed")))
