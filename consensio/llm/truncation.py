"""Queries p1_: texts that were cut off, and how often each source cuts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.functions.keys import norm_endpoint, norm_key
from consensio.llm.endings import with_cut
from consensio.sources.tables import table


def run_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Run rows as texts of sources (see endings.limits); the text is in `output`."""
    runs = table(spark, sf, "agent_runs").where("rec_type = 'run'")
    return runs.select(F.lit("agent_runs").alias("origin"), F.col("log_pos").alias("row_key"), norm_endpoint("endpoint").alias("endpoint"), norm_key("model_id").alias("model"), F.length("output").alias("chars"), F.octet_length("output").alias("bytes"), F.lit(None).cast("int").alias("tokens"), F.col("output").alias("text"), norm_key("task_id").alias("task"))


def completion_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "completions")
    return c.select(F.lit("completions").alias("origin"), F.col("completion_id").alias("row_key"), norm_endpoint("endpoint").alias("endpoint"), norm_key("model").alias("model"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.col("tokens_out").alias("tokens"), "text", F.lit(None).cast("string").alias("task"))


def judged_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = run_texts(spark, sf).unionByName(completion_texts(spark, sf))
    return with_cut(texts, F.col("text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return judged_texts(spark, sf).where("is_cut").select(F.col("origin").alias("table_name"), "row_key")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, and those cut off, by table and endpoint and by table and model; blank texts are not counted."""
    rows = judged_texts(spark, sf).where("evidence IS NOT NULL")
    each = F.explode(F.array(F.struct(F.lit("endpoint").alias("dim"), F.col("endpoint").alias("source")), F.struct(F.lit("model").alias("dim"), F.col("model").alias("source"))))
    rows = rows.select("origin", "is_cut", each.alias("e"))
    out = rows.groupBy(F.col("origin").alias("table_name"), "e.dim", "e.source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    return out.withColumn("rate", F.round(F.col("n_cut") / F.col("n_texts"), 6))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
SQL: dict[str, str] = {}
