"""Null models of agreement: labels shuffled, uniform, or drawn anew from each model's own marginal.

Agents are never copied. A replicate of a cell is a draw of its label counts, multinomial or hypergeometric,
made for all replicates at once where the folded cell is; only sums over groups are shuffled. Draws depend on the seed
and the cell, so a task that is run again draws the same.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensio.operators.durable import fits, hot_keys, salted_join
from consensio.operators.labels import cell_measures
from consensio.operators.order import null_safe_join
from consensio.operators.resample import _keys, _sums, measure_of, percentile_ci

#: Cells that one task deals labels to.
CHUNK_CELLS = 500


def _rng(seed: int, h: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(h) & (2**64 - 1)]))


def gap(counts: DataFrame, keys: Sequence[str], reps: DataFrame, by: Sequence[str], measure: str = "cd_primary") -> DataFrame:
    """by, observed, n_cells, null_mean, delta and the interval of observed less null. reps: by, b, mean."""
    whole = counts.groupBy(*keys, "target", "label").agg(F.sum("n").alias("n"))
    observed = cell_measures(whole, keys).groupBy(*by).agg(F.avg(measure).alias("observed"), F.count(F.lit(1)).alias("n_cells"))
    ci = percentile_ci(reps, "mean", by).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    null = null_safe_join(reps.groupBy(*by).agg(F.avg("mean").alias("null_mean")), ci, by)
    out = null_safe_join(observed, null, by)
    return out.select(*by, "observed", "n_cells", "null_mean", (F.col("observed") - F.col("null_mean")).alias("delta"), (F.col("observed") - F.col("_hi")).alias("lo"), (F.col("observed") - F.col("_lo")).alias("hi"))


def _means(cells: DataFrame, by: Sequence[str], draw, b: int, measure: str) -> DataFrame:
    """by, b, mean of the measure over cells; draw(row) gives (counts, labels)."""

    def fold(pdf: pd.DataFrame):
        for g, row in zip(_keys(pdf, by), pdf.itertuples(index=False)):
            drawn, labels = draw(row)
            v = measure_of(drawn, labels, row.x_target, measure)
            yield g, (np.ones(b), np.nan_to_num(v))

    return _sums(cells, by, fold, ["w", "s"]).select(*by, "b", (F.col("s") / F.col("w")).alias("mean"))


def uniform(counts: DataFrame, keys: Sequence[str], size: str, by: Sequence[str], b: int = 1000, seed: int = 42, measure: str = "cd_primary") -> DataFrame:
    """by, b, mean when every agent takes one of the `size` interpretations I0.. of its task at random; a cell of no interpretation counts 0.

    counts: keys, size (may be a key), target, label, n.
    """
    cell = counts.groupBy(*keys, *[c for c in (size,) if c not in keys], "target").agg(F.sum("n").alias("x_n"))
    cell = cell.select(*by, F.col("target").alias("x_target"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("x_size"), "x_n", F.xxhash64(*keys).alias("x_hash"))

    def draw(row):
        m = max(0, row.x_size)
        drawn = _rng(seed, row.x_hash).multinomial(row.x_n, np.full(m, 1 / m), b) if m else np.zeros((b, 0))
        return drawn, [f"I{i}" for i in range(m)]

    return _means(cell, by, draw, b, measure)


def redrawn(counts: DataFrame, keys: Sequence[str], pool: DataFrame, by: Sequence[str], model: str = "model", b: int = 500, seed: int = 42, measure: str = "cd_primary") -> DataFrame:
    """by, b, mean when every agent draws a label from the marginal of its own model in `pool` (model, label, n), which has every model.

    A model's marginal is one row of its labels; it is joined to the cells' models and never to agents.
    """
    marginal = pool.groupBy(model, "label").agg(F.sum("n").alias("n")).groupBy(model).agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("l"), F.col("n").alias("n")))).alias("x_pool"))
    own = counts.where(F.col(model).isNotNull()).groupBy(*keys, "target", model).agg(F.sum("n").alias("x_n"))
    own = own.join(F.broadcast(marginal), model) if fits(marginal) else salted_join(own, marginal, [model], hot_keys(own, [model]))
    cell = own.groupBy(*keys, "target").agg(F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), F.col("x_n").alias("n"), F.col("x_pool").alias("p")))).alias("x_models"))
    cell = cell.select(*by, F.col("target").alias("x_target"), "x_models", F.xxhash64(*keys).alias("x_hash"))

    def draw(row):
        labels = sorted({x["l"] for m in row.x_models for x in m["p"]})
        at, rng, drawn = {x: i for i, x in enumerate(labels)}, _rng(seed, row.x_hash), np.zeros((b, len(labels)))
        for m in row.x_models:
            n = np.array([x["n"] for x in m["p"]], float)
            drawn[:, [at[x["l"]] for x in m["p"]]] += rng.multinomial(m["n"], n / n.sum(), b)
        return drawn, labels

    return _means(cell, by, draw, b, measure)


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Good ones among n drawn; from a thousand million on, where the exact draw is not offered, the normal law of the same mean and spread."""
    total = good + bad
    if total.max(initial=0) < 10**9:
        return rng.hypergeometric(good, bad, n)
    p = good / np.maximum(total, 1)
    sd = np.sqrt(n * p * (1 - p) * (total - n) / np.maximum(total - 1, 1))
    return np.clip(np.rint(rng.normal(n * p, sd)), np.maximum(0, n - bad), np.minimum(n, good)).astype(np.int64)


def deal(rng: np.random.Generator, pool: np.ndarray, sizes: Sequence[int]):
    """For each size in turn, as many labels out of the pool for each replicate, none put back; pool: (replicates, labels)."""
    rest = pool.astype(np.int64).copy()
    for size in sizes:
        need, left = np.full(len(rest), size, np.int64), rest.sum(1)
        out = np.zeros_like(rest)
        for k in range(rest.shape[1]):
            left -= rest[:, k]
            out[:, k] = _hypergeometric(rng, rest[:, k], left, need) if k + 1 < rest.shape[1] else need
            need -= out[:, k]
        rest -= out
        yield out


def shuffled(counts: DataFrame, keys: Sequence[str], condition: Sequence[str], by: Sequence[str], b: int = 1000, seed: int = 42, measure: str = "cd_primary", expected: bool = False) -> DataFrame:
    """by, b, mean when the labels of a condition are shuffled among its agents; cells keep their sizes. expected: by and the mean over all replicates.

    counts: keys, condition (among the keys), target, label, n. A condition's labels are dealt to chunks of about
    CHUNK_CELLS cells first and from each chunk to its cells, so no task holds a condition's cells; `by` are keys too.
    """
    if not set(condition) <= set(keys) or not set(by) <= set(keys):
        raise ValueError("condition and by must be keys")
    cell = counts.groupBy(*keys, "target").agg(F.sum("n").alias("x_n"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("x_cells") / CHUNK_CELLS))
    per = cell.groupBy(*condition).agg(F.count(F.lit(1)).alias("x_cells"))
    cell = null_safe_join(cell, per, condition).withColumn("x_hash", F.xxhash64(*keys)).withColumn("x_chunk", F.pmod("x_hash", chunks).cast("int"))
    pools = counts.groupBy(*condition, "label").agg(F.sum("n").alias("n")).groupBy(*condition).agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("l"), F.col("n").alias("n")))).alias("x_pool"))
    sizes = cell.groupBy(*condition, "x_chunk").agg(F.sum("x_n").alias("x_n")).groupBy(*condition).agg(F.sort_array(F.collect_list(F.struct(F.col("x_chunk").alias("c"), F.col("x_n").alias("n")))).alias("x_sizes"))
    one = null_safe_join(pools, sizes, condition).withColumn("x_hash", F.xxhash64(*condition))
    one = one.repartition(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in condition)

    def to_chunks(frames):
        for pdf in frames:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                pool = np.tile(np.array([x["n"] for x in row["x_pool"]], np.int64), (b, 1))
                key = {c: None if row[c] is None or row[c] != row[c] else row[c] for c in condition}
                for x, drawn in zip(row["x_sizes"], deal(_rng(seed, row["x_hash"]), pool, [x["n"] for x in row["x_sizes"]])):
                    yield pd.DataFrame([key | {"x_chunk": x["c"], "x_labels": [y["l"] for y in row["x_pool"]], "x_drawn": drawn.ravel().tolist()}], dtype=object)

    dealt = one.mapInPandas(to_chunks, f"{kinds}, x_chunk int, x_labels array<string>, x_drawn array<bigint>")
    # all cells of a chunk in one row: as many as a chunk has
    held = cell.groupBy(*condition, "x_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("x_hash").alias("h"), F.col("x_n").alias("n"), F.col("target").alias("t"), F.struct(*[F.col(c) for c in by]).alias("g")))).alias("x_held"))
    both = null_safe_join(held, dealt, [*condition, "x_chunk"]).select("x_held", "x_labels", "x_drawn", F.xxhash64(*condition, "x_chunk").alias("x_hash"))
    def fold(pdf: pd.DataFrame):
        for row in pdf.itertuples(index=False):
            labels = list(row.x_labels)
            pool = np.asarray(row.x_drawn, np.int64).reshape(b, len(labels))
            for x, drawn in zip(row.x_held, deal(_rng(seed + 1, row.x_hash), pool, [x["n"] for x in row.x_held])):
                v = np.nan_to_num(measure_of(drawn, labels, x["t"], measure))
                if expected:
                    v = v.mean(keepdims=True)
                yield tuple(x["g"][c] for c in by), (np.ones(len(v)), v)

    return _sums(both, by, fold, ["w", "s"], counts).select(*by, *([] if expected else ["b"]), (F.col("s") / F.col("w")).alias("mean"))
