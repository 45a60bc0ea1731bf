"""Label counts of cells kept up to date from a growing log.

Counts by (cell, label) can be added up, so cells follow from them at any time. Records repeat; a record counts
once by its identity as long as its time is within the watermark, after which its state is let go.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ["task_id", "config", "model_role", "model_id", "seed"]


def once(stream: DataFrame, time: str = "ts", late: str = "45 days", identity: list[str] = IDENTITY) -> DataFrame:
    """Each record of a stream once within the time that copies may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def counts_of(batch: DataFrame) -> DataFrame:
    own = batch.where((F.col("rec_type") == "run") & (F.trim("label") != ""))
    return own.groupBy("task_id", "config", "seed", F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def keep_counts(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends the counts of each batch under its number; a batch that is run again replaces its own.

    Sum n over (cell, label) to read the present counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts_of(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def present_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("task_id", "config", "seed", "label").agg(F.sum("n").alias("n"))
