"""Cutting of lineage, and joins that survive hot keys."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there.

    The folder is the session's spark.checkpoint.dir. Where none is set, a session with its executors in one process
    gets a temporary one, which is removed at its end; a cluster has no folder that all machines share, so
    that is an error. Set spark.cleaner.referenceTracking.cleanCheckpoints to have written tables removed when they are
    no longer used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def scratch(spark, name: str) -> str:
    """A new folder under the checkpoint folder, which all executors share; see `cut`."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def hot_keys(df: DataFrame, keys: list[str], bound: int = 1000) -> DataFrame:
    """Keys that hold more than 1/bound of all rows; by their definition fewer than `bound` of them.

    Null keys are left out. Empty input gives an empty result.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).dropna(subset=keys)
    total = df.count()
    return counts.where(F.col("n") > F.lit(total / bound)).select(*keys)


#: Rows and bytes of a frame that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and no more than so many bytes as text.

    Partitions are read a few at a time until the rows are too many; nothing is shuffled for it, and only a number for
    each row comes to the driver.
    """
    wide = [f"`{c}`" for c, t in df.dtypes if not t.startswith("map")]
    text = F.octet_length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
    found = df.select(text.alias("n")).take(rows + 1)
    return len(found) <= rows and sum(r[0] or 0 for r in found) <= size


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner", salts: int = 32, condition=None) -> DataFrame:
    """Equi-join of left with right on keys, where rows of left with a hot key are spread over `salts` tasks.

    `hot` must be bounded (see hot_keys); it is broadcast. Rows of right with a hot key are repeated
    `salts` times. `how` is inner, left, left_semi or left_anti. Null keys match nothing. Rows of left that are
    equal in all columns share a task.
    condition(salted_left, salted_right) may add a further condition.
    """
    mark = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    # by what the row holds, so that a task that is run again after a loss sends every row where it went before
    plain = [f"`{c}`" for c, t in left.dtypes if not t.startswith(("map", "variant")) and "map<" not in t]
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    a = left.join(mark, keys, "left").withColumn("_salt", spread).drop("_hot").alias("a")
    b = right.join(mark, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    if condition is None:
        return a.join(b, [*keys, "_salt"], how).drop("_salt")
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_salt"]})
    on = F.col("_salt") == F.col("_r__salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return a.join(b, on & condition(), how).drop("_salt", "_r__salt", *[f"_r_{k}" for k in keys])
