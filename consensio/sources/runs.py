"""Run logs and tasks as one tidy relation with a row for each agent."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.functions.keys import norm_endpoint, norm_key
from consensio.operators.durable import fits, hot_keys, salted_join
from consensio.sources.tables import table

#: Classes of the models of the given tables; another roster is a parameter.
MODEL_CLASSES = {
    "ostrel/lumen-large": "homogeneous", "dunmar/pith-2-think": "reasoning", "sarvik/novel-r1": "reasoning", "quorra/glass-xl": "reasoning",
    "ostrel/lumen-mini": "weak", "kivala/strata-8b": "weak", "peltho/arc-small": "weak", "tessib/open-13b": "weak",
}
#: Families that built the tasks: by prefix of the task id, and all others.
CONSTRUCTORS = {"r2xf_": "kivala", "": "ostrel"}


def model_class(config: Column, model: Column, classes: Mapping[str, str] = MODEL_CLASSES) -> Column:
    """A heterogeneous debate is its own class; then the roster decides, then the name of the method."""
    c = F.when(config == "heterogeneous-mad", "heterogeneous")
    for m, k in classes.items():
        c = c.when(model == m, k)
    return c.when(config.contains("homogeneous"), "homogeneous").otherwise("unknown")


def target_of(interpretations: str = "interpretations") -> Column:
    """The first target interpretation, else I0."""
    first = F.get(F.filter(interpretations, lambda x: x["is_target"]), F.lit(0))
    return F.coalesce(first["id"], F.lit("I0"))


def constructor(task: Column, constructors: Mapping[str, str] = CONSTRUCTORS) -> Column:
    c = F.when(F.lit(False), F.lit(""))
    for prefix, family in sorted(constructors.items(), key=lambda x: -len(x[0])):
        c = c.when(task.startswith(prefix), family)
    return c


def endpoint_guard(runs: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Runs of one endpoint ('' is the default one); without one named, several are an error."""
    own = runs.withColumn("_e", norm_endpoint("endpoint"))
    if endpoint is not None:
        return own.where(F.col("_e") == endpoint).drop("_e")
    seen = [r[0] for r in own.select("_e").distinct().limit(2).collect()]
    if len(seen) > 1:
        raise ValueError(f"several endpoints, for example {sorted(seen)}: name the one that is meant")
    return own.drop("_e")


def tidy_runs(runs: DataFrame, tasks: DataFrame, classes: Mapping[str, str] = MODEL_CLASSES, constructors: Mapping[str, str] = CONSTRUCTORS) -> DataFrame:
    """Run rows with a label and a known task, with the task's metadata.

    runs: log_pos, rec_type, task_id, config, model_role, model_id, output, label, confidences, seeds. Rows of
    other types, with a null or blank label or an unknown task are dropped; null seeds are 0. Tasks are
    broadcast after a check of their number, else hot tasks are salted.
    """
    t = tasks.select(norm_key("id").alias("task"), target_of().alias("target"), "regime", F.col("ambiguity_level").alias("ambiguity_k"), "domain", F.size("interpretations").alias("n_interpretations"))
    small = fits(t)
    t = t.dropna(subset=["task"]).dropDuplicates(["task"])
    method, model = norm_key("config"), norm_key("model_id")
    r = runs.where((F.col("rec_type") == "run") & (F.trim("label") != "")).select(
        F.col("log_pos").alias("uid"), norm_key("task_id").alias("task"), method.alias("method"), model.alias("model"), norm_key("model_role").alias("role"), model_class(method, model, classes).alias("model_class"), F.substring_index(model, "/", 1).alias("family"),
        F.coalesce("replicate_seed", "seed", F.lit(0)).cast("bigint").alias("seed"), F.trim("label").alias("label"), F.col("verbalized_conf").alias("conf"), "logit_conf", "output",
    )
    out = r.join(F.broadcast(t), "task") if small else salted_join(r, t, ["task"], hot_keys(r, ["task"]))
    return out.withColumn("constructor_family", constructor(F.col("task"), constructors))


def tidy(spark: SparkSession, folder: str) -> DataFrame:
    return tidy_runs(table(spark, folder, "agent_runs"), table(spark, folder, "tasks"))
