"""Schemas of the data model, and checks on ingest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERPRETATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("is_target", T.BooleanType()), T.StructField("gold_check", T.StringType())])
TASK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("latent_spec", T.StringType()),
    T.StructField("interpretations", T.ArrayType(INTERPRETATION)), T.StructField("ambiguity_level", T.IntegerType()), T.StructField("key_questions", T.ArrayType(T.StringType())), T.StructField("regime", T.StringType()),
])
RUN_LOG = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("config", T.StringType()), T.StructField("model_role", T.StringType()), T.StructField("model_id", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("label", T.StringType()), T.StructField("verbalized_conf", T.DoubleType()), T.StructField("logit_conf", T.DoubleType()),
    T.StructField("seed", T.LongType()), T.StructField("replicate_seed", T.LongType()), T.StructField("endpoint", T.StringType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("_corrupt", T.StringType()),
])
TRIAL = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("session_code", "participant_id", "label", "item_id", "condition")], *[T.StructField(c, T.IntegerType()) for c in ("complete", "accept", "confidence", "gap_choice", "gap_correct")],
    T.StructField("rt_sec", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in ("order_index", "group_g")], T.StructField("lang", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("passed_comprehension", "passed_attention")],
    T.StructField("total_time_sec", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in ("straightline_confidence", "duplicate_id", "age_group", "ai_use")],
])

#: Label of a degenerate answer, and the regimes a task may be tagged with. Fixed values.
I_PERP = "I_perp"
REGIMES = ["H1_external", "H2_derivable"]


def bad_regimes(tasks: DataFrame) -> DataFrame:
    """Tasks whose regime is neither null nor known; an ingest refuses them."""
    return tasks.where(F.col("regime").isNotNull() & ~F.col("regime").isin(REGIMES))
