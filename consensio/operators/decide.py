"""Verdicts from interval bounds, equivalence tests and small driver-side inference."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED, REFUTED, INCONCLUSIVE = "SUPPORTED", "REFUTED", "INCONCLUSIVE"


def verdict(lo: Column, hi: Column, at_least_zero: bool = False) -> Column:
    """SUPPORTED if the interval is above 0 (or from 0 on), REFUTED if it is below, else INCONCLUSIVE; so are NULL bounds."""
    above = lo >= 0 if at_least_zero else lo > 0
    return F.when(lo.isNull() | hi.isNull(), INCONCLUSIVE).when(above, SUPPORTED).when(hi < 0, REFUTED).otherwise(INCONCLUSIVE)


def verdict_h2(interaction_lo: Column, interaction_hi: Column, reasoner_lo: Column) -> Column:
    """REFUTED if reasoners are significantly above the single agent; SUPPORTED if the interaction excludes 0."""
    excludes = (interaction_lo > 0) | (interaction_hi < 0)
    return F.when(F.coalesce(reasoner_lo > 0, F.lit(False)), REFUTED).when(F.coalesce(excludes, F.lit(False)), SUPPORTED).otherwise(INCONCLUSIVE)


def robustness(points: list[Column]) -> Column:
    """'robust:<sign>' if the known points agree in sign, with '(partial)' if one is NULL; 'divergent' or 'indeterminate'."""
    signs = F.array(*[F.when(p > 0, "+").when(p < 0, "-").when(p == 0, "0") for p in points])
    known = F.filter(signs, lambda s: s.isNotNull())
    tag = F.concat(F.lit("robust:"), F.get(known, F.lit(0)), F.when(F.size(known) < len(points), "(partial)").otherwise(""))
    return F.when(F.size(known) == 0, "indeterminate").when(F.size(F.array_distinct(known)) == 1, tag).otherwise("divergent")


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function."""
    x = df / (df + t * t)
    if x <= 0:
        tail = 0.0
    elif x >= 1:
        tail = 1.0
    else:
        a, b = df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        tail = front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def tost(n: int, mean: float, sd: float, margin: float, alpha: float = 0.05) -> dict[str, float | bool | None]:
    """Paired equivalence test from a mean and its spread; undefined below two pairs, decided by the mean where nothing varies."""
    if n < 2:
        return {"lo": None, "hi": None, "p": None, "equivalent": None}
    se = sd / math.sqrt(n)
    if se == 0:
        inside = abs(mean) < margin
        return {"lo": mean, "hi": mean, "p": 0.0 if inside else 1.0, "equivalent": inside}
    p = max(1 - t_cdf((mean + margin) / se, n - 1), t_cdf((mean - margin) / se, n - 1))
    half = t_quantile(1 - alpha, n - 1) * se
    return {"lo": mean - half, "hi": mean + half, "p": p, "equivalent": p < alpha}


def holm(p: list[float]) -> list[float]:
    """Holm's step-down p values in the given order."""
    m, top, out = len(p), 0.0, [0.0] * len(p)
    for i, k in enumerate(sorted(range(m), key=lambda k: p[k])):
        top = max(top, min(1.0, (m - i) * p[k]))
        out[k] = top
    return out
