"""Grids of jobs, what is missing of them, and shards that must agree."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def job_grid(tasks: DataFrame, configs: list[str], seeds: list[int], models: list[str], pools: dict[str, str], agents: dict[str, int]) -> DataFrame:
    """task, config, model, seed, least, most: tasks x configs x models of the config x seeds.

    A config in pools has one row, whose model is the pool's name; agents: rows of a job, 1 where not named.
    """
    def struct(c: str, m: str):
        return F.struct(F.lit(c).alias("config"), F.lit(m).alias("model"), F.lit(agents.get(c, 1)).alias("least"))

    each = F.array(*[struct(c, m) for c in configs for m in ([pools[c]] if c in pools else models)])
    grid = tasks.select("task", F.explode(each).alias("j")).select("task", "j.config", "j.model", "j.least")
    return grid.select("task", "config", "model", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("seed"), "least", F.col("least").alias("most"))


def pooled_models(observed: DataFrame, pools: dict[str, str], members: list[str]) -> DataFrame:
    """observed with the pool's name for model where the config has a pool and the model is one of its members."""
    model = F.col("model")
    for c, name in pools.items():
        model = F.when((F.col("config") == c) & F.col("model").isin(members), name).otherwise(model)
    return observed.withColumn("model", model)


def compare_grids(expected: DataFrame, observed: DataFrame, keys: list[str], least: str = "least", most: str | None = None) -> DataFrame:
    """Cells of both sides with `status`: ok, missing, underfilled (fewer than expected.least rows), overfilled (more than expected.most, if named) or unexpected.

    expected: keys, least and most; observed: keys, a row for each observation. Null keys match nothing.
    """
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = expected.withColumn("_e", F.lit(1)).join(seen, keys, "full_outer")
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") < F.col(least), "underfilled")
    if most:
        status = status.when(F.col("n") > F.col(most), "overfilled")
    status = status.otherwise("ok")
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def merge_shards(records: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """keys, n_read, n_distinct of each key; a key of more than one distinct payload is in conflict.

    Payloads are compared by a hash of 128 bits, so a key of very many copies is folded like any other.
    """
    text = F.to_json(F.struct(*payload))
    return records.withColumn("_h", F.md5(text)).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n_read"), F.count(F.lit(1)).alias("n_distinct"))


def refuse_conflicts(merged: DataFrame) -> None:
    """Raise if any key is in conflict; names a few."""
    bad = merged.where("n_distinct > 1").limit(5).collect()
    if bad:
        raise ValueError(f"shards disagree, for example at {[tuple(r) for r in bad]}")


def first_wins(log: DataFrame, identity: list[str], position: str) -> DataFrame:
    """The row of the smallest position of each identity; folded, not sorted. Positions are unique."""
    first = log.groupBy(*identity).agg(F.min(position).alias(position))
    return log.join(first.select(position), position, "left_semi")


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def listed(cells: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """The first cells of each status but ok, in the order of their keys: status, place, keys, n. A report of `most` rows for each status.

    Each partition keeps its own first ones before the shuffle, so no task sorts all cells of a status.
    """
    bad = cells.where("status <> 'ok'").select("status", *keys, "n")
    part = bad.withColumn("_p", F.pmod(F.xxhash64(*keys), F.lit(64)))
    first = part.withColumn("_k", F.row_number().over(W.partitionBy("status", "_p").orderBy(*keys))).where(F.col("_k") <= most)
    return first.withColumn("place", F.row_number().over(W.partitionBy("status").orderBy(*keys)).cast("bigint")).where(F.col("place") <= most).select("status", "place", *keys, "n")
