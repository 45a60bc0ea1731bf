"""Steps of the studies around the log: task assembly, labels from checks, recovery gates, interventions, trials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consensio.operators.labels import ratio
from consensio.schema import I_PERP


def assemble(specs: DataFrame, deleted: Column) -> DataFrame:
    """Tasks from full specifications with some classes of requirements deleted.

    specs: id, core, classes array<struct<id, clauses array<string>>>, interpretations array<struct<id, is_target,
    opened_by, gold_check>> (opened_by: class ids with commas, or null). The prompt keeps the clauses of the other
    classes; the target stays, and another interpretation is opened if all classes it needs are deleted. The check
    of one that needs exactly the deleted classes gets the suffix __combdef. `valid` is false where a deleted class
    is unknown or named twice, there is not one target, or the prompt has not become shorter.
    """
    every = F.transform("classes", lambda c: c["id"])
    kept = F.filter("classes", lambda c: ~F.array_contains(F.col("_del"), c["id"]))

    def text(classes: Column) -> Column:
        return F.concat_ws("\n\n", F.concat(F.array("core"), F.flatten(F.transform(classes, lambda c: c["clauses"]))))

    def needs(i: Column) -> Column:
        return F.transform(F.split(i["opened_by"], ","), lambda c: F.trim(c))

    def opened(i: Column) -> Column:
        return i["is_target"] | (i["opened_by"].isNotNull() & (F.size(F.array_except(needs(i), F.col("_del"))) == 0))

    def branch(i: Column) -> Column:
        exact = (F.size("_del") > 0) & ~i["is_target"] & (F.size(F.array_except(F.col("_del"), needs(i))) == 0)
        return F.struct(i["id"].alias("id"), i["is_target"].alias("is_target"), F.when(exact, F.concat(i["gold_check"], F.lit("__combdef"))).otherwise(i["gold_check"]).alias("gold_check"))

    out = specs.withColumn("_del", F.coalesce(deleted, F.array().cast("array<string>")))
    out = out.withColumns({"prompt": text(kept), "latent_spec": text(F.col("classes")), "ambiguity_level": F.size("_del"), "opened": F.transform(F.filter("interpretations", opened), branch)})
    known = (F.size(F.array_except("_del", every)) == 0) & (F.size(F.array_distinct("_del")) == F.size("_del"))
    one = F.size(F.filter("opened", lambda i: i["is_target"])) == 1
    shorter = (F.size("_del") == 0) | (F.length("prompt") < F.length("latent_spec"))
    return out.withColumn("valid", known & one & shorter).drop("_del", "interpretations", "classes", "core").withColumnRenamed("opened", "interpretations")


def power_set(specs: DataFrame) -> DataFrame:
    """id, ok: whether the sets of classes that open the wrong interpretations are distinct and as many as the non-empty subsets of the classes."""
    sets = F.transform(F.filter("interpretations", lambda i: ~i["is_target"]), lambda i: F.sort_array(F.transform(F.split(i["opened_by"], ","), lambda c: F.trim(c))))
    n = F.pow(F.lit(2), F.size("classes")) - 1
    return specs.select("id", ((F.size(F.array_distinct(sets)) == n) & (F.size(sets) == n)).alias("ok"))


def certification_failures(interpretations: Column, level: Column) -> Column:
    """What is wrong with a task's interpretations: their number is not 2 ** level, not one target, ids repeat, checks are missing, or fewer checks than readings."""
    i, checks = interpretations, F.filter(interpretations["gold_check"], lambda c: c.isNotNull())
    found = {
        "size": F.size(i) != F.pow(F.lit(2), level), "targets": F.size(F.filter(i, lambda x: x["is_target"])) != 1, "ids": F.size(F.array_distinct(i["id"])) != F.size(i),
        "unchecked": F.size(checks) < F.size(i), "indistinct": F.size(F.array_distinct(checks)) < F.size(i),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in found.items()]), lambda x: x.isNotNull())


def label_from_checks(checks: DataFrame, key: str) -> DataFrame:
    """key, label from one row for each (candidate, interpretation): the only one that passes, else I_perp. Nulls do not pass."""
    ok = F.coalesce("passed", F.lit(False))
    g = checks.groupBy(key).agg(F.countDistinct(F.when(ok, F.col("interpretation"))).alias("n"), F.min(F.when(ok, F.col("interpretation"))).alias("one"))
    return g.select(key, F.when(F.col("n") == 1, F.col("one")).otherwise(I_PERP).alias("label"))


def selected_candidate(text: Column, n: int) -> Column:
    """The smallest i for which text names `candidate i`; 0 if it names none."""
    low, out = F.lower(text), None
    for i in range(n):
        hit = low.contains(f"candidate {i}")
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.coalesce(out, F.lit(0)) if out is not None else F.lit(0)


def recovery(tidy: DataFrame) -> DataFrame:
    """Share of each task's answers that are its target."""
    return tidy.groupBy("task", "regime").agg(F.avg((F.col("label") == F.col("target")).cast("double")).alias("recovery"), F.count(F.lit(1)).alias("n"))


def recovery_gate(items: DataFrame, high: float = 0.6, low: float = 0.4, margin: float = 0.2) -> DataFrame:
    """PASS if derivable tasks recover, external ones do not, and they are apart; FAIL if either kind is absent."""
    h2, h1 = (F.avg(F.when(F.col("regime") == r, F.col("recovery"))) for r in ("H2_derivable", "H1_external"))
    out = items.agg(h2.alias("mean_h2"), h1.alias("mean_h1"))
    ok = (F.col("mean_h2") >= high) & (F.col("mean_h1") <= low) & (F.col("mean_h2") - F.col("mean_h1") >= margin)
    return out.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def family_verdicts(rows: DataFrame, tasks: DataFrame, resolve: float = 0.5, concentration: float = 0.5) -> DataFrame:
    """Each family of tasks (the id before _k) by the means of its rows (task, n_target, n_agents, cd_primary, iperp_rate).

    RESOLVES where the target is reached often enough and wrong answers do not concentrate, else MIS-TAGGED; a
    family of tasks without rows is INSUFFICIENT-DATA.
    """
    family = F.substring_index("task", "_k", 1).alias("family")
    s = rows.groupBy(family).agg(F.avg(ratio(F.col("n_target"), F.col("n_agents"))).alias("resolve_rate"), F.avg("cd_primary").alias("cd_primary"), F.avg("iperp_rate").alias("iperp_rate"), F.count(F.lit(1)).alias("n_rows"))
    verdict = F.when(F.col("n_rows").isNull(), "INSUFFICIENT-DATA").when((F.col("resolve_rate") >= resolve) & (F.col("cd_primary") <= concentration), "RESOLVES").otherwise("MIS-TAGGED")
    out = tasks.select(family).distinct().join(s, "family", "left").withColumn("verdict", verdict)
    return out.select("family", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "resolve_rate", "cd_primary", "iperp_rate", "verdict")


def clarify(records: DataFrame, tau: float = 0.5) -> DataFrame:
    """records (is_flagged, h_seed, seed_labels, n_surfaced) with the decision of each policy as a map; unknown signals do not ask."""
    labels = F.filter("seed_labels", lambda x: x.isNotNull())
    flags = {"lpp_gated": F.col("is_flagged"), "always": F.lit(True), "semantic_entropy_gated": F.col("h_seed") > tau, "self_consistency_gated": F.size(F.array_distinct(labels)) > 1, "requirements_probing_gated": F.col("n_surfaced") > 0}
    return records.withColumn("clarify", F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))]))


def intervention_items(records: DataFrame, policies: list[str], target: str = "I0") -> DataFrame:
    """One row for each task of records (task_id, stratum, h_seed, clarify, b2, na): rates of asking, concentrations before and after, hits.

    Records marked na are left out. A concentration is NULL without labels.
    """
    own = records.where(~F.coalesce("na", F.lit(False)))
    base = own.groupBy("task_id").agg(F.min("stratum").alias("stratum"), F.avg("h_seed").alias("h_seed"), F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.coalesce(F.col("clarify")[p], F.lit(False)).cast("double")).alias(p) for p in policies], F.avg((F.col("b2.oracle_label") == target).cast("double")).alias("i0_hit"))
    for side in ("baseline", "oracle"):
        n = own.where(F.col(f"b2.{side}_label").isNotNull()).groupBy("task_id", F.col(f"b2.{side}_label").alias("x")).agg(F.count(F.lit(1)).alias("n"))
        wrong = (F.col("x") != target) & (F.col("x") != I_PERP)
        base = base.join(n.groupBy("task_id").agg(ratio(F.coalesce(F.max(F.when(wrong, F.col("n"))), F.lit(0)), F.sum("n")).alias(f"cd_{side}")), "task_id", "left")
    return base


def paired_drop(items: DataFrame, stratum: str = "AMB+") -> DataFrame:
    """Means before and after over the items of a stratum with both, their difference, and how many are not resolved."""
    own = items.where((F.col("stratum") == stratum) & F.col("cd_baseline").isNotNull() & F.col("cd_oracle").isNotNull())
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("cd_baseline").alias("baseline"), F.avg("cd_oracle").alias("oracle"), F.avg(F.col("cd_baseline") - F.col("cd_oracle")).alias("drop"), F.avg("i0_hit").alias("i0_hit"), F.count_if(F.col("cd_oracle") > 0).alias("n_unresolved"), F.count_if(F.col("i0_hit") < 1).alias("n_partial"))


def gold_stratum(n_distinct: Column, questions: Column) -> Column:
    """AMB+ where interpretations differ in result, NON-DISC where only an axis is declared, else AMB-."""
    return F.when(n_distinct >= 2, "AMB+").when(F.coalesce(F.size(questions), F.lit(0)) > 0, "NON-DISC").otherwise("AMB-")


def flat_trials(rounds: DataFrame) -> DataFrame:
    """rounds (participant_id, round_number, confidence, rt_ms, t_start, t_end, ...) with what the export adds.

    order_index from 0; rt_sec; total_time_sec by the clock, or by the trials' times where the clock is missing;
    straightline_confidence: 1 where two or more confidences are all equal.
    """
    p = rounds.groupBy("participant_id").agg(
        F.when((F.count("confidence") > 1) & (F.min("confidence") == F.max("confidence")), 1).otherwise(0).alias("straightline_confidence"),
        F.round(F.coalesce(F.max("t_end") - F.min("t_start"), F.coalesce(F.sum("rt_ms"), F.lit(0)) / 1000.0), 1).alias("total_time_sec"),
    )
    out = rounds.join(p, "participant_id")
    return out.withColumn("order_index", F.col("round_number") - 1).withColumn("rt_sec", F.round(F.col("rt_ms") / 1000.0, 1)).drop("round_number", "rt_ms", "t_start", "t_end")
