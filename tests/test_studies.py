"""Task assembly, labels from checks, interventions and trials."""

import pytest
from pyspark.sql import functions as F

from consensio.operators import studies as S

SPEC = "id string, core string, classes array<struct<id string, clauses array<string>>>, interpretations array<struct<id string, is_target boolean, opened_by string, gold_check string>>, gone array<string>"


def spec(gone):
    return ("s", "Core.", [("a", ["A."]), ("b", ["B.", "B2."])], [("I0", True, None, "g0"), ("I1", False, "a", "g1"), ("I2", False, "b", "g2"), ("I3", False, "a, b", "g3")], gone)


def test_assemble(spark):
    got = S.assemble(spark.createDataFrame([spec([]), spec(["a"]), spec(["b", "a"]), spec(["x"]), spec(["a", "a"]), spec(None)], SPEC), F.col("gone")).collect()
    assert [r["valid"] for r in got] == [True, True, True, False, False, True]
    assert got[0]["prompt"] == got[0]["latent_spec"] == "Core.\n\nA.\n\nB.\n\nB2."
    assert got[1]["prompt"] == "Core.\n\nB.\n\nB2." and got[1]["ambiguity_level"] == 1
    assert [(i["id"], i["gold_check"]) for i in got[1]["interpretations"]] == [("I0", "g0"), ("I1", "g1__combdef")]
    assert [(i["id"], i["gold_check"]) for i in got[2]["interpretations"]] == [("I0", "g0"), ("I1", "g1"), ("I2", "g2"), ("I3", "g3__combdef")]
    assert S.power_set(spark.createDataFrame([spec([])], SPEC)).first()["ok"]


def test_labels_from_checks(spark):
    rows = [("a", "I0", True), ("a", "I1", False), ("b", "I0", True), ("b", "I1", True), ("c", "I0", None), ("d", "I1", True), ("d", "I1", True)]
    got = {r["k"]: r["label"] for r in S.label_from_checks(spark.createDataFrame(rows, "k string, interpretation string, passed boolean"), "k").collect()}
    assert got == {"a": "I0", "b": "I_perp", "c": "I_perp", "d": "I1"}
    texts = spark.createDataFrame([("I take Candidate 2.",), ("none",), (None,), ("candidate 1 beats candidate 0",)], "t string")
    assert [r[0] for r in texts.select(S.selected_candidate(F.col("t"), 3)).collect()] == [2, 0, 0, 0]


def test_interventions(spark):
    rows = [("t", "AMB+", 0.2, ["I1", "I1"], True, 1, ("I1", "I0"), None), ("t", "AMB+", 0.8, ["I1", "I0"], False, 0, ("I1", "I1"), None), ("t", "AMB+", None, None, None, None, None, True), ("u", "AMB-", None, [], None, 0, None, False)]
    df = spark.createDataFrame(rows, "task_id string, stratum string, h_seed double, seed_labels array<string>, is_flagged boolean, n_surfaced int, b2 struct<baseline_label string, oracle_label string>, na boolean")
    items = S.intervention_items(S.clarify(df), ["lpp_gated", "always", "semantic_entropy_gated", "self_consistency_gated"])
    t = items.where("task_id = 't'").first()
    assert (t["lpp_gated"], t["always"], t["semantic_entropy_gated"], t["self_consistency_gated"]) == (0.5, 1.0, 0.5, 0.5)
    assert (t["cd_baseline"], t["cd_oracle"], t["i0_hit"], t["n_rows"]) == (1.0, 0.5, 0.5, 2)
    assert items.where("task_id = 'u'").first()["cd_oracle"] is None
    d = S.paired_drop(items).first()
    assert (d["n"], d["drop"], d["n_unresolved"], d["n_partial"]) == (1, 0.5, 1, 1)


def test_gates_and_strata(spark):
    items = spark.createDataFrame([("H2_derivable", 0.9), ("H1_external", 0.1)], "regime string, recovery double")
    assert S.recovery_gate(items).first()["verdict"] == "PASS"
    assert S.recovery_gate(items.where("regime = 'H1_external'")).first()["verdict"] == "FAIL"
    rows = spark.createDataFrame([(2, []), (1, ["q"]), (1, None)], "n int, q array<string>")
    assert [r[0] for r in rows.select(S.gold_stratum(F.col("n"), F.col("q"))).collect()] == ["AMB+", "NON-DISC", "AMB-"]


def test_flat_trials(spark):
    rows = [("p", 1, 3, 1500.0, 10.0, 100.0), ("p", 2, 3, 500.0, 10.0, 100.0), ("q", 1, 2, 1500.0, None, None), ("q", 2, None, None, None, None)]
    got = {(r["participant_id"], r["order_index"]): r for r in S.flat_trials(spark.createDataFrame(rows, "participant_id string, round_number int, confidence int, rt_ms double, t_start double, t_end double")).collect()}
    assert got["p", 0]["straightline_confidence"] == 1 and got["p", 0]["total_time_sec"] == 90.0
    assert got["q", 0]["straightline_confidence"] == 0 and got["q", 1]["total_time_sec"] == 1.5 and got["q", 0]["rt_sec"] == pytest.approx(1.5)
