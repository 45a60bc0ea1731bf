"""Estimating equations with exchangeable correlation for trials clustered by participant, and simulated trials for their power."""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensio.operators.linear import design


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _participants(df: DataFrame, y: str, k: int, cluster: str) -> DataFrame:
    """A row for each participant with y and the design as arrays; a participant has a handful of trials."""
    own = df.dropna(subset=[y, cluster, *[f"_x{i}" for i in range(k)]])
    return own.groupBy(cluster).agg(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), *[F.col(f"_x{i}").cast("double").alias(f"x{i}") for i in range(k)])).alias("r")).select("r")


def _sum(rows: DataFrame, k: int, fold) -> np.ndarray:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            for r in pdf["r"]:
                v = fold(np.array([x["y"] for x in r]), np.array([[x[f"x{i}"] for i in range(k)] for x in r]))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()  # a few hundred numbers
    return np.array([v for _, v in sorted(map(tuple, found))])


def fit(df: DataFrame, y: str, names: Sequence[str], cluster: str, binomial: bool = False, rounds: int = 50) -> dict:
    """Coefficients and their covariance, bias-reduced for few clusters (Mancl and DeRouen), from a design (see linear.design).

    The mean is a logit for binomial y and y itself else; the correlation within a participant is one number, estimated by moments. Each
    round is one sum over participants. status: 'ok', 'not-converged', 'singular' or 'no-data', and without 'ok' or 'not-converged'
    there are no numbers.
    """
    k = len(names)
    rows = _participants(df, y, k, cluster).persist()
    none = {"names": list(names), "beta": np.full(k, np.nan), "cov": np.full((k, k), np.nan)}

    def parts(beta, ys, x):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if binomial else eta
        v = np.maximum(mu * (1 - mu), 1e-9) if binomial else np.ones(len(ys))
        return ys - mu, v, (v[:, None] if binomial else 1.0) * x

    def inverse(n, alpha):
        return (np.eye(n) - alpha / (1 + (n - 1) * alpha)) / (1 - alpha)

    try:
        beta, alpha, status = np.zeros(k), 0.0, "not-converged"
        for _ in range(rounds):

            def step(ys, x, beta=beta, alpha=alpha):
                e, v, d = parts(beta, ys, x)
                w = inverse(len(ys), alpha) / np.sqrt(np.outer(v, v))
                p = e / np.sqrt(v)
                n = len(ys)
                return np.r_[(d.T @ w @ d).ravel(), d.T @ w @ e, (p * p).sum(), (p.sum() ** 2 - (p * p).sum()) / 2, n, n * (n - 1) / 2]

            t = _sum(rows, k, step)
            if not len(t):
                return none | {"status": "no-data"}
            a, c, (ss, cross, n, n_pairs) = t[: k * k].reshape(k, k), t[k * k : k * k + k], t[-4:]
            if np.linalg.matrix_rank(a) < k:
                return none | {"status": "singular"}
            change = np.linalg.solve(a, c)
            scale = ss / max(1, n - k)
            beta = beta + change
            before, alpha = alpha, float(np.clip(cross / max(1.0, n_pairs - k) / max(scale, 1e-12), -0.05, 0.95)) if n_pairs > k else 0.0
            if np.abs(change).max() < 1e-8 and abs(alpha - before) < 1e-8:
                status = "ok"
                break
        bread = np.linalg.inv(a)

        def meat(ys, x):
            e, v, d = parts(beta, ys, x)
            w = inverse(len(ys), alpha) / np.sqrt(np.outer(v, v))
            h = d @ bread @ d.T @ w
            g = d.T @ w @ np.linalg.pinv(np.eye(len(ys)) - h) @ e
            return np.outer(g, g).ravel()

        return {"status": status, "names": list(names), "beta": beta, "cov": bread @ _sum(rows, k, meat).reshape(k, k) @ bread, "alpha": alpha}
    finally:
        rows.unpersist()


def contrast(result: dict, terms: dict[str, float]) -> tuple[float | None, float | None, float | None]:
    """Estimate, standard error and z of a sum of coefficients; NULLs where one is missing or has no error."""
    if any(t not in result["names"] for t in terms):
        return None, None, None
    w = np.zeros(len(result["names"]))
    for t, v in terms.items():
        w[result["names"].index(t)] = v
    est, var = float(w @ result["beta"]), float(w @ result["cov"] @ w)
    if not np.isfinite(est) or not var > 0:
        return None, None, None
    return est, math.sqrt(var), est / math.sqrt(var)


def simulated(spark, participants: int, items: int = 14, effect: float = 0.5, spread: float = 0.5, seed: int = 1) -> DataFrame:
    """participant_id, item_id, condition, complete, accept: trials with an effect of the condition 'fake' on accepting, in log-odds.

    Every number follows from a hash of the seed, the participant and the item. Half of the items are complete; conditions take turns
    over participants.
    """
    def uniform(*parts):
        return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) + 0.5) / 1_000_003

    p = spark.range(participants).select(F.col("id").alias("participant_id"), F.element_at(F.array(*[F.lit(c) for c in ("single", "fake", "dep")]), (F.col("id") % 3 + 1).cast("int")).alias("condition"))
    # a normal of two uniforms
    p = p.withColumn("u", F.lit(spread) * F.sqrt(-2 * F.log(uniform(F.lit("r"), F.col("participant_id")))) * F.cos(2 * math.pi * uniform(F.lit("a"), F.col("participant_id"))))
    t = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("item_id")).withColumn("complete", F.col("item_id") % 2)
    odds = F.lit(-0.3) + F.col("u") + F.when((F.col("condition") == "fake") & (F.col("complete") == 0), effect).otherwise(0.0) + 0.8 * F.col("complete")
    return t.select("participant_id", "item_id", "condition", "complete", (uniform(F.lit("y"), F.col("participant_id"), F.col("item_id")) < 1 / (1 + F.exp(-odds))).cast("int").alias("accept"))


def power(spark, sizes: Sequence[int], effects: Sequence[float], runs: int = 20, level: float = 0.05) -> DataFrame:
    """participants, effect, share of simulated studies in which 'fake' is found above 'single' on incomplete items."""
    out = []
    for n in sizes:
        for e in effects:
            hits = 0
            for s in range(runs):
                t = simulated(spark, n, effect=e, seed=s + 1).where("complete = 0").withColumns({"fake": F.when(F.col("condition") == "fake", 1.0).otherwise(0.0), "dep": F.when(F.col("condition") == "dep", 1.0).otherwise(0.0)})
                d, names = design(t, ["fake", "dep"])
                z = contrast(fit(d, "accept", names, "participant_id", True), {"fake": 1.0})[2]
                hits += z is not None and 1 - normal_cdf(z) < level
            out.append((int(n), float(e), hits / runs))
    return spark.createDataFrame(out, "participants int, effect double, power double")
