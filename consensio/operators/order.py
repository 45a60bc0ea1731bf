"""Order statistics without a task that holds a whole order: values are cut into ranges, ranges are ordered by themselves."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.operators.durable import cut

#: Ranges that values are cut into; each is ordered by itself.
PARTS = 64


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, on, how).drop(*[f"_r_{k}" for k in keys])


def parts_of(df: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """df with `_part`, the range its value is in; equal values share one. Bounds are approximate percentiles, so ranges are of about one size."""
    levels = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(value, levels, 10 * parts)).first()[0]
    bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn("_part", F.lit(0))
    at = F.array(*[F.lit(x) for x in bounds])
    return df.withColumn("_part", F.size(F.filter(at, lambda x: x < F.col(value))))


def running_sums(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str | Column], parts: int = PARTS) -> DataFrame:
    """df with, for each name, the sum of its column over the rows of the group with a smaller value; df has a row for each group and value.

    Null values are left out. Within a range a window adds up, and what lies before a range comes from a table of
    ranges, of at most `parts` rows for each group.
    """
    # written once, as it is read for the bounds, the ranges and the rows
    own = parts_of(cut(df.where(F.col(value).isNotNull()).withColumns({f"_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})), value, parts)
    zero = F.lit(0)
    inner = W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = own.groupBy(*by, "_part").agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    ranges = ranges.select(*by, "_part", *[F.coalesce(F.sum(n).over(before), zero).alias(f"_o_{n}") for n in sums])
    inside = own.withColumns({n: F.coalesce(F.sum(f"_{n}").over(inner), zero) for n in sums})
    out = null_safe_join(inside, ranges, [*by, "_part"])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def percentiles(df: DataFrame, by: Sequence[str], value: str, levels: dict[str, float], lower: bool = False) -> DataFrame:
    """by and, for each name, the percentile with linear interpolation, or the lower of the two values; nulls are left out, a group of nulls alone too.

    Exact: rows are folded to distinct values, and the two values around the wanted place are picked by running counts.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    total = per.groupBy(*by).agg(F.sum("_k").alias("_n"))
    own = null_safe_join(running_sums(per, by, value, {"_before": "_k"}), total, by) if by else running_sums(per, by, value, {"_before": "_k"}).join(F.broadcast(total))
    upto = F.col("_before") + F.col("_k")
    picked = []
    for n, p in levels.items():
        place = (F.col("_n") - 1) * F.lit(p)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picked.append(F.min(F.when(upto > at, F.col(value))).alias(f"_{n}_{side}"))
    out = own.groupBy(*by).agg(*picked, F.max("_n").alias("_n"))
    if lower:
        return out.select(*by, *[F.col(f"_{n}_lo").alias(n) for n in levels])
    share = {n: (F.col("_n") - 1) * F.lit(p) - F.floor((F.col("_n") - 1) * F.lit(p)) for n, p in levels.items()}
    return out.select(*by, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * share[n]).alias(n) for n in levels])
