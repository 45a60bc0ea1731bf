"""Run logs, tasks, shards and tables of trials as JSON lines and CSV."""

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from consensio.operators.completeness import refuse_conflicts
from consensio.schema import RUN_LOG, TASK, TRIAL


def existing(paths: list[str] | str) -> list[str]:
    """Paths that exist; a pattern stands for all files it matches. Remote paths are left as they are."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        out += [p] if ":/" in p else sorted(glob.glob(p))
    return out


def first_existing(*sets: list[str] | str) -> list[str]:
    """The paths of the first set that has any; the others are what to fall back on."""
    return next((found for s in sets if (found := existing(s))), [])


def write_sample(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A sample for coders as CSV with a header, or as JSON lines."""
    out = df.coalesce(1).write.mode("errorifexists")
    out.option("header", True).option("quoteAll", True).option("escape", '"').csv(path) if kind == "csv" else out.json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as a report; doubles to four decimals, NULL as a dash, and a line that says so if there are more rows."""
    rows = df.limit(most + 1).collect()

    def cell(v) -> str:
        return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "/").replace("\n", " ")

    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join([*lines, *([f"(more than {most} rows)"] if len(rows) > most else [])]) + "\n"


def resolve_folder(name: str, start: str = ".") -> str | None:
    """The folder of that name in start or the nearest of its ancestors."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, name)):
            return os.path.join(at, name)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


def read_lines(spark: SparkSession, paths: list[str] | str, schema: StructType, corrupt: str | None = "_corrupt") -> DataFrame:
    """JSON lines of all paths; malformed and blank lines are dropped. No path, an empty frame with these columns."""
    found = existing(paths)
    own = StructType([f for f in schema if f.name != corrupt])
    if not found:
        return spark.createDataFrame([], own)
    if corrupt is None or corrupt not in schema.fieldNames():
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(found)
    # the reader parses a line only if another column than the corrupt one is asked for, so the filter names one that is always true
    parsed = F.length(F.concat_ws("", F.lit("x"), F.col(own[0].name).cast("string"))) > 0
    return rows.where(F.col(corrupt).isNull() & parsed).drop(corrupt)


def read_run_log(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Records of a run log: run, job_done and cost_delta; others (old markers, headers) are ignored."""
    return read_lines(spark, paths, RUN_LOG).where(F.col("type").isin("run", "job_done", "cost_delta"))


def labelled_runs(log: DataFrame, tasks: DataFrame) -> DataFrame:
    """Run records with a label that is not blank and a known task."""
    known = tasks.select(F.col("id").alias("task_id")).dropna().distinct()
    return log.where((F.col("type") == "run") & (F.trim("label") != "")).join(known, "task_id", "left_semi")


def read_tasks(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return read_lines(spark, paths, TASK, None)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_new(new: DataFrame, path: str, identity: list[str], schema: StructType = RUN_LOG) -> int:
    """Append rows whose identity is not in the log yet; repeats in `new` are written once. Returns how many.

    Null identity columns compare as equal. Each call writes whole files, so a lost task leaves nothing half written.
    """
    spark = new.sparkSession
    old = read_lines(spark, f"{path}/*.json", schema) if ":/" not in path else read_lines(spark, path, schema)
    key = F.md5(F.to_json(F.struct(*[F.col(c).cast("string") for c in identity]), {"ignoreNullFields": "false"}))
    fresh = new.withColumn("_k", key).dropDuplicates(["_k"]).join(old.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k").persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").json(path)
        return n
    finally:
        fresh.unpersist()


def union_lines(spark: SparkSession, paths: list[str] | str, schema: StructType) -> DataFrame:
    """Records of the distinct lines of all paths; lines are trimmed, blank and malformed ones dropped."""
    found = existing(paths)
    if not found:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(found).select(F.trim("value").alias("value")).where("value <> ''").distinct()
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").where(F.get_json_object("value", "$").isNotNull()).select("r.*")


def read_shards(spark: SparkSession, pattern: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Records of all shards with the file each is from; header lines are skipped.

    Fails loudly: a malformed line or a record without one of its keys is an error.
    """
    found = existing(pattern)
    if not found:
        raise FileNotFoundError(pattern)
    full = StructType(list(schema)).add("_header", "boolean")
    rows = spark.read.schema(full).option("mode", "FAILFAST").json(found).select("*", F.col("_metadata.file_name").alias("shard"))
    rows = rows.where(~F.coalesce("_header", F.lit(False))).drop("_header")
    bad = rows.where(" OR ".join(f"{k} IS NULL" for k in keys)).select("shard").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]}: a record lacks one of {keys}")
    return rows


def read_headers(paths: list[str]) -> dict[str, dict]:
    """The header of each local shard that has one, by path; headers are first lines, one of each file."""
    out = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            first = f.readline()
        try:
            head = json.loads(first)
        except ValueError:
            continue
        if isinstance(head, dict) and head.get("_header"):
            out[p] = head
    return out


def same_fingerprint(headers: dict[str, dict], fields: list[str]) -> dict:
    """The fingerprint that all headers share; another one is an error."""
    prints = {p: {k: (h.get("_fingerprint") or {}).get(k) for k in fields} for p, h in headers.items()}
    first = next(iter(prints.values()), {})
    bad = [p for p, f in prints.items() if f != first]
    if bad:
        raise ValueError(f"fingerprints differ: {sorted(bad)[:3]}")
    return first


def write_merged(records: DataFrame, keys: list[str], header: dict, path: str) -> None:
    """One file: a header line, then the records in the order of their keys, each once. Conflicts must have been refused.

    Merged reports are small; this is the only place that writes a single file.
    """
    from consensio.operators.completeness import merge_shards

    payload = [c for c in records.columns if c not in keys]
    refuse_conflicts(merge_shards(records, keys, payload))
    lines = records.dropDuplicates(keys).orderBy(*keys).select(F.to_json(F.struct(*records.columns)))
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"_header": True} | header) + "\n")
        for r in lines.toLocalIterator():
            f.write(r[0] + "\n")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials from CSV with identifiers as text; blanks are null."""
    return spark.read.schema(TRIAL).option("header", True).option("nullValue", "").csv(path)


def exclude_trials(trials: DataFrame, answered: int = 14) -> DataFrame:
    """Trials with an answer of participants with so many answered trials who passed the attention check."""
    per = trials.groupBy("participant_id").agg(F.count("accept").alias("_n"), F.min("passed_attention").alias("_a"))
    return trials.join(per.where((F.col("_n") == answered) & (F.col("_a") == 1)).select("participant_id"), "participant_id", "left_semi").where("accept IS NOT NULL")


def trial_summary(trials: DataFrame) -> DataFrame:
    """Acceptance by condition, over all trials and over first ones, and the rate by gap."""
    return trials.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("accept").alias("accept"), F.avg(F.when(F.col("order_index") == 0, F.col("accept"))).alias("accept_first"), F.avg("gap_correct").alias("gap_correct"))


def requested_seeds(path: str) -> list[int]:
    """Distinct seeds of a run manifest in their order; a manifest without any is an error."""
    with open(path, encoding="utf-8") as f:
        seeds = json.load(f).get("seeds")
    if not isinstance(seeds, list) or not seeds or not all(isinstance(s, int) and not isinstance(s, bool) for s in seeds):
        raise ValueError(f"{path}: no seeds")
    return list(dict.fromkeys(seeds))
