"""Bootstrap of items and of clusters, with weights that any engine can repeat.

A replicate weights each item, task or model by a Poisson number of mean 1, which depends on the seed, the replicate
and the item alone: nothing is numbered, drawn or joined, and all replicates of an item are made where the item
is. A task folds its rows to one number for each group and replicate, so what is shuffled does not grow
with the rows. The 32 bits behind a weight are a quarter of an MD5, see `weights`.
"""

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.operators.labels import ratio
from consensio.operators.order import parts_of
from consensio.schema import I_PERP

#: Bounds in 32 bits between the Poisson numbers 0, 1, 2, ... of mean 1; a weight is the number of bounds at or below its bits.
POISSON = [int(sum(np.exp(-1.0) / np.prod(np.arange(1.0, j + 1)) for j in range(k + 1)) * 2**32) for k in range(11)]
_BOUNDS = np.array(POISSON, np.uint32)


@lru_cache(maxsize=4096)
def weights(seed: int, level: str, b: int) -> np.ndarray:
    """Weights of a level in replicates 0..b-1: bits of replicate i are place i % 4 of the MD5 of 'seed|i // 4|level'."""
    blocks = b"".join(hashlib.md5(f"{seed}|{k}|{level}".encode()).digest() for k in range(-(-b // 4)))
    return np.searchsorted(_BOUNDS, np.frombuffer(blocks, ">u4")[:b], "right").astype(np.uint8)


def percentile_ci(reps: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Linear percentiles of the replicates; there are B of them in each group."""
    a = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(value, F.lit(a)).alias("lo"), F.percentile(value, F.lit(1 - a)).alias("hi"))


def index_ci(reps: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The replicates at the sorted places int(0.025 n) - 1, at least 0, and int(0.975 n), at most n - 1. The replicates of a group are an array of B values."""
    s = F.sort_array(F.collect_list(value))
    n = F.size("s")
    out = reps.where(F.col(value).isNotNull()).groupBy(*by).agg(s.alias("s"))
    return out.select(*by, F.get("s", F.greatest(F.lit(0), F.floor(n * 0.025).cast("int") - 1)).alias("lo"), F.get("s", F.least(n - 1, F.floor(n * 0.975).cast("int"))).alias("hi"))


def _sums(df: DataFrame, by: Sequence[str], fold, names: Sequence[str], kinds_of: DataFrame | None = None) -> DataFrame:
    """by, b and sums of vectors over the replicates; fold(pdf) yields (key of a group, vectors). kinds_of has the columns of by, if df has not."""
    types = [(df if kinds_of is None else kinds_of).schema[c].dataType.simpleString() for c in by]
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in zip(by, types)), "b int", *(f"{n} double" for n in names)])
    whole = [t in ("tinyint", "smallint", "int", "bigint") for t in types]  # which pandas makes doubles where some are null

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list[np.ndarray]] = {}
        for pdf in frames:
            for key, vectors in fold(pdf):
                if key in total:
                    for t, v in zip(total[key], vectors):
                        t += v
                else:
                    total[key] = [np.array(v, np.float64) for v in vectors]
        for key, vectors in total.items():
            out = pd.DataFrame({c: pd.Series([int(k) if i and k is not None else k] * len(vectors[0]), dtype=object) for c, k, i in zip(by, key, whole)})
            out["b"] = np.arange(len(vectors[0]), dtype=np.int32)
            for n, v in zip(names, vectors):
                out[n] = v
            yield out

    # folded rows are few bytes and much work, which adaptive planning would put into one task
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.mapInPandas(run, kinds).groupBy(*by, "b").agg(*[F.sum(n).alias(n) for n in names])


def _keys(pdf: pd.DataFrame, by: Sequence[str]) -> Iterator[tuple]:
    return zip(*[[None if x is None or x != x else x for x in pdf[c]] for c in by]) if by else iter([()] * len(pdf))


def resampled_means(values: DataFrame, key: str, value: str, b: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """by, b, mean: means of weighted values. values has a row for each key (an item) of a group; rows without a value are left out."""

    def fold(pdf: pd.DataFrame):
        for g, k, v in zip(_keys(pdf, by), pdf["_k"], pdf["_v"]):
            w = weights(seed, k, b).astype(float)
            yield g, (w, w * v)

    own = values.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_v"))
    return _sums(own, by, fold, ["w", "s"]).select(*by, "b", F.try_divide("s", F.nullif("w", F.lit(0.0))).alias("mean"))


def mean_ci(values: DataFrame, key: str, value: str, b: int = 2000, seed: int = 42) -> DataFrame:
    """point, lo, hi of the mean; NULL without values."""
    return _one(values.agg(F.avg(value).alias("point")), index_ci(resampled_means(values, key, value, b, seed), "mean"))


def signed_ci(values: DataFrame, key: str, value: str, group: str, signs: dict[str, int], b: int = 2000, seed: int = 42) -> DataFrame:
    """point, lo, hi of a signed sum of the means of independent groups; NULL if one has no values.

    {a: 1, c: -1} is a difference, {a: 1, c: -1, d: -1, e: 1} an interaction. Items are weighted by group and key.
    """
    own = values.where(F.col(group).isin(list(signs))).withColumn("_item", F.concat_ws("|", F.col(group), F.col(key).cast("string")))
    reps = resampled_means(own, "_item", value, b, seed, [group])

    def total(mean):
        return sum((F.max(F.when(F.col(group) == g, mean)) * s for g, s in signs.items()), F.lit(0.0))

    point = own.groupBy(group).agg(F.avg(value).alias("_m")).agg(total(F.col("_m")).alias("point"))
    return _one(point, index_ci(reps.groupBy("b").agg(total(F.col("mean")).alias("d")), "d"))


def _one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row side by side."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


def auroc_ci(items: DataFrame, level: str, score: str, positive: str, b: int = 2000, seed: int = 42) -> DataFrame:
    """lo, hi of the area under the curve when the clusters (level) of items are weighted.

    Replicates without both classes are left out. Items are folded to (score, cluster) and cut into ranges of
    scores; a range gives its weights and its own wins for each replicate, and ranges are put together by sums.
    """
    own = items.where(F.col(score).isNotNull() & F.col(positive).isNotNull() & F.col(level).isNotNull())
    own = own.groupBy(F.col(score).alias("_s"), F.col(level).cast("string").alias("_k")).agg(F.count_if(positive).cast("double").alias("_p"), F.count_if(~F.col(positive)).cast("double").alias("_q"))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        s, ps, qs = pdf["_s"].to_numpy(), pdf["_p"].to_numpy(), pdf["_q"].to_numpy()
        below, p, q, wins = (np.zeros(b) for _ in range(4))
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        for i, j in zip(cuts[:-1], cuts[1:]):
            p1, q1 = np.zeros(b), np.zeros(b)
            for k in range(i, j):
                w = weights(seed, pdf["_k"].iat[k], b).astype(float)
                p1 += ps[k] * w
                q1 += qs[k] * w
            wins += p1 * (below + q1 / 2)
            below += q1
            p += p1
            q += q1
        return pd.DataFrame({"part": key[0], "b": np.arange(b, dtype=np.int32), "p": p, "q": q, "wins": wins})

    parts = parts_of(own, "_s").groupBy("_part").applyInPandas(fold, "part int, b int, p double, q double, wins double")
    below = F.coalesce(F.sum("q").over(W.partitionBy("b").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    a = parts.withColumn("wins", F.col("wins") + F.col("p") * below).groupBy("b").agg(ratio(F.sum("wins"), F.sum("p") * F.sum("q")).alias("a"))
    return index_ci(a, "a")


def measure_of(counts: np.ndarray, labels: Sequence[str], target: str, measure: str = "cd_primary") -> np.ndarray:
    """A measure of cells for all replicates: counts has a row for each replicate and a column for each label; NaN for an empty cell."""
    labels = np.asarray(labels, object)
    perp = labels == I_PERP
    wrong = labels != target
    n = counts.sum(1)
    if measure == "iperp_rate":
        top = counts[:, perp].sum(1)
    else:
        own = counts[:, wrong if measure == "cd_frozen" else wrong & ~perp]
        top = own.max(1) if own.shape[1] else np.zeros(len(counts))
    if measure == "cd_drop_iperp":
        rest = counts[:, ~perp].sum(1)
        out = np.divide(top, rest, out=np.zeros(len(counts)), where=rest > 0)
        return np.where(n > 0, out, np.nan)
    return np.divide(top, n, out=np.full(len(counts), np.nan), where=n > 0)


def cell_replicates(counts: DataFrame, keys: Sequence[str], by: Sequence[str], b: int = 500, seed: int = 42, how: str = "two-way", measure: str = "cd_primary", task: str = "task", model: str = "model") -> DataFrame:
    """by, b, mean: weighted means of a measure of cells in each replicate.

    counts: keys (with the task), model, target, label, n. how: 'two-way' weights tasks and models independently,
    'task' only tasks, 'agent' every agent by itself. A task's weight is that of its cells, a model's weights its
    labels within a cell; as a cell's key has the task but no model, a model drawn twice never merges cells, and a task
    drawn m times is m equal cells. Cells whose agents all have weight 0 are left out. The label counts of a
    cell are gathered in one row, as many as its labels and models.
    """
    if how not in ("two-way", "task", "agent"):
        raise ValueError(how)
    cell = counts.groupBy(*keys, "target").agg(F.collect_list(F.struct(F.col("label").alias("l"), F.col(model).cast("string").alias("m"), F.col("n").cast("double").alias("n"))).alias("_c"))
    cell = cell.select(*by, F.col(task).cast("string").alias("_t"), F.col("target").alias("_g"), F.xxhash64(*keys).alias("_h"), "_c")

    def fold(pdf: pd.DataFrame):
        for g, t, target, h, c in zip(_keys(pdf, by), pdf["_t"], pdf["_g"], pdf["_h"], pdf["_c"]):
            labels = sorted({x["l"] for x in c})
            own = np.zeros((b, len(labels)))
            rng = np.random.Generator(np.random.Philox(key=[seed, h & (2**64 - 1)])) if how == "agent" else None
            for x in sorted(c, key=lambda x: (x["l"], x["m"] or "")):
                at = labels.index(x["l"])
                if how == "two-way":
                    own[:, at] += x["n"] * weights(seed + 1, x["m"] or "", b).astype(float)
                else:
                    own[:, at] += rng.poisson(x["n"], b) if how == "agent" else x["n"]
            v = measure_of(own, labels, target, measure)
            w = np.where(np.isnan(v), 0.0, 1.0 if how == "agent" else weights(seed, t or "", b).astype(float))
            yield g, (w, w * np.nan_to_num(v))

    return _sums(cell, by, fold, ["w", "s"]).select(*by, "b", F.try_divide("s", F.nullif("w", F.lit(0.0))).alias("mean"))


__all__ = ["POISSON", "auroc_ci", "cell_replicates", "index_ci", "mean_ci", "measure_of", "percentile_ci", "resampled_means", "signed_ci", "weights"]
