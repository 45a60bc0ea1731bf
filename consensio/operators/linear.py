"""Linear models from sums: cluster-robust least squares and a random intercept, with a handful of numbers on the driver."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Ratios of the variance between clusters to that within them, that are tried.
RATIOS = np.r_[0.0, np.geomspace(1e-4, 1e3, 71)]


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with more than one value, in order; nulls are no value."""
    n = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if n[c]]


def design(df: DataFrame, numeric: Sequence[str] = (), factors: dict[str, Sequence[str]] | None = None, products: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, list[str]]:
    """df with columns of a design, and their names: an intercept, numbers, a dummy for each value of a factor but its first, products of two terms.

    A term of a product is a number or a factor; that of two factors has a column for each pair of their dummies.
    """
    terms: dict[str, dict[str, Column]] = {n: {n: F.col(n).cast("double")} for n in numeric}
    for f, values in (factors or {}).items():
        terms[f] = {f"{f}[{v}]": (F.col(f) == v).cast("double") for v in values[1:]}
    columns = {"intercept": F.lit(1.0)}
    for t in terms.values():
        columns |= t
    for a, b in products:
        columns |= {f"{x}:{y}": u * v for x, u in terms[a].items() for y, v in terms[b].items()}
    return df.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(columns.values())]), list(columns)


def _clusters(df: DataFrame, y: str, k: int, cluster: str) -> DataFrame:
    """Of each cluster: n, sums of x, of x x', of x y, of y and of y y; rows with a null are left out."""
    xs = [f"_x{i}" for i in range(k)]
    own = df.dropna(subset=[y, cluster, *xs])
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"{a}y") for a in xs] + [F.sum(a).alias(f"{a}s") for a in xs]
    sums += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    return own.groupBy(cluster).agg(*sums).drop(cluster)


def _stats(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
    xx = np.zeros((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            xx[:, i, j] = xx[:, j, i] = pdf[f"x{i}_{j}"]
    return pdf["n"].to_numpy(), np.stack([pdf[f"_x{i}s"] for i in range(k)], 1), xx, np.stack([pdf[f"_x{i}y"] for i in range(k)], 1), pdf["y"].to_numpy(), pdf["yy"].to_numpy()


def _total(clusters: DataFrame, k: int, fold) -> np.ndarray:
    """The sum over clusters of a vector of numbers that fold makes of their statistics."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            if len(pdf):
                v = fold(*_stats(pdf, k))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = clusters.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()  # as many as the vector is long
    return np.array([v for _, v in sorted(map(tuple, rows))])


def fit(df: DataFrame, y: str, names: Sequence[str], cluster: str) -> dict:
    """Coefficients with 95 % intervals and a status, from a design (see `design`).

    A random intercept for each cluster by restricted maximum likelihood over RATIOS ('ok:single_re'); where that finds no spread
    between clusters or the design has not full rank, least squares with cluster-robust errors ('ok:ols_cluster',
    'rank-deficient'); 'too-few-clusters' below two clusters or without freedom, and then there are no intervals. Only sums over clusters
    leave the executors.
    """
    k = len(names)
    stats = _clusters(df, y, k, cluster).persist()
    try:

        def sums(n, x, xx, xy, ys, yy):
            return np.r_[len(n), n.sum(), xx.sum(0).ravel(), xy.sum(0)]

        t = _total(stats, k, sums)
        if not len(t) or t[0] < 2 or t[1] <= k:
            return {"status": "too-few-clusters", "names": list(names), "beta": np.full(k, np.nan), "se": np.full(k, np.nan)}
        g, n_all, gram, right = int(t[0]), t[1], t[2 : 2 + k * k].reshape(k, k), t[2 + k * k :]
        full = np.linalg.matrix_rank(gram) == k

        def shrunk(n, x, xx, xy, ys, yy):
            out = []
            for r in RATIOS:
                w = r / (1 + n * r)
                a = xx.sum(0) - np.einsum("g,gi,gj->ij", w, x, x)
                out.append(np.r_[a.ravel(), xy.sum(0) - np.einsum("g,gi,g->i", w, x, ys), yy.sum() - (w * ys * ys).sum(), np.log1p(n * r).sum()])
            return np.concatenate(out)

        if full:
            best = None
            for r, v in zip(RATIOS, _total(stats, k, shrunk).reshape(len(RATIOS), -1)):
                a, c, q, logdet = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-2], v[-1]
                beta = np.linalg.solve(a, c)
                s2 = max((q - beta @ c) / (n_all - k), 1e-300)
                score = -0.5 * ((n_all - k) * np.log(s2) + logdet + np.linalg.slogdet(a)[1])
                if best is None or score > best[0] + 1e-9:
                    best = score, r, beta, np.sqrt(np.maximum(np.diag(np.linalg.inv(a)) * s2, 0))
            if best[1] > 0:
                return {"status": "ok:single_re", "names": list(names), "beta": best[2], "se": best[3]}
        inverse = np.linalg.pinv(gram)
        beta = inverse @ right

        def meat(n, x, xx, xy, ys, yy):
            s = xy - np.einsum("gij,j->gi", xx, beta)
            return np.einsum("gi,gj->ij", s, s).ravel()

        m = _total(stats, k, meat).reshape(k, k) * g / (g - 1) * (n_all - 1) / (n_all - k)
        return {"status": "ok:ols_cluster" if full else "rank-deficient", "names": list(names), "beta": beta, "se": np.sqrt(np.maximum(np.diag(inverse @ m @ inverse), 0))}
    finally:
        stats.unpersist()


def interval(result: dict, name: str) -> tuple[float | None, float | None, float | None, str]:
    """Point, bounds and status of one coefficient; NULLs where it is not in the design or has no error."""
    if name not in result["names"]:
        return None, None, None, "absent"
    i = result["names"].index(name)
    b, s = float(result["beta"][i]), float(result["se"][i])
    ok = np.isfinite(s)
    return (b if np.isfinite(b) else None), (b - Z95 * s if ok else None), (b + Z95 * s if ok else None), result["status"]
