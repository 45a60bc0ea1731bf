"""Selections, checks, samples, lists and reports on small fixtures with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from consensio.operators import checks, completeness, contrasts, evaluation, filters
from consensio.sources import runlog


def test_filters(spark):
    df = spark.createDataFrame([("single", 0, "a", "a"), ("sc", 1, "a", "b"), (None, 0, None, "b"), ("sc", None, "c", None)], "method string, seed bigint, family string, constructor_family string")
    assert filters.of_methods(df, ["sc"]).count() == 2 and filters.of_methods(df, []).count() == 0
    assert filters.of_seeds(df, [0]).count() == 2 and filters.of_seeds(df, None).count() == 4
    kept, n = filters.hold_out(df)
    assert kept.count() == 3 and tuple(n.first()) == (3, 1)
    filters.refuse_shared_families({"weak": ["a"]}, {"judge": "b", "constructor": "b"})
    with pytest.raises(ValueError, match="judge"):
        filters.refuse_shared_families({"weak": ["a", "b"]}, {"judge": "b"})


def test_checks_label_answers(spark):
    own = checks.Checks()
    own.add("d", "I0")(lambda a: a.contains("x"))
    own.add("d", "I1")(lambda a: a.contains("y"))
    with pytest.raises(ValueError, match="I0"):
        own.add("d", "I0")(lambda a: a.isNull())
    df = spark.createDataFrame([("d", "x"), ("d", "xy"), ("d", None), ("e", "x"), (None, "x")], "domain string, answer string")
    assert [r["label"] for r in checks.label_answers(df, own, "domain", "answer").collect()] == ["I0", "I_perp", "I_perp", "I_perp", "I_perp"]
    blocks = spark.createDataFrame([(["I1", "I1"],), (["I1", "I0"],), ([],), (None,), ([None],)], "l array<string>")
    assert [r[0] for r in blocks.select(checks.agreed_label(F.col("l"))).collect()] == ["I1", "I_perp", "I_perp", "I_perp", "I_perp"]


def test_lists_are_short_and_ordered(spark):
    cells = spark.createDataFrame([(f"t{i:03}", "missing", 0) for i in range(200)] + [("u", "ok", 4), ("v", "overfilled", 9)], "task string, status string, n bigint").repartition(7)
    got = completeness.listed(cells, ["task"], 50).collect()
    assert sorted((r["place"], r["task"]) for r in got if r["status"] == "missing") == [(i + 1, f"t{i:03}") for i in range(50)]
    assert [(r["place"], r["n"]) for r in got if r["status"] == "overfilled"] == [(1, 9)] and not [r for r in got if r["status"] == "ok"]
    assert completeness.listed(cells.limit(0), ["task"]).count() == 0


def test_signal_sample_tops_up_with_rows_not_taken(spark):
    rows = [(i, "rare" if i < 2 else "common") for i in range(100)]
    df = spark.createDataFrame(rows, "uid bigint, signal string")
    got = evaluation.signal_sample(df.repartition(5), "signal", "uid", 20).collect()
    assert len(got) == len({r["uid"] for r in got}) == 20 and sum(r["signal"] == "rare" for r in got) == 2
    assert {r["uid"] for r in got} == {r["uid"] for r in evaluation.signal_sample(df.repartition(2), "signal", "uid", 20).collect()}
    assert evaluation.signal_sample(df.limit(3), "signal", "uid", 20).count() == 3 and evaluation.signal_sample(df.limit(0), "signal", "uid", 20).count() == 0


def test_coding_rows(spark):
    runs = spark.createDataFrame([(1, "a", "It is I3, Interpretation I2 (x)"), (2, "z", None), (3, None, "ok")], "log_pos bigint, task string, output string")
    tasks = spark.createDataFrame([("a", "d", None), ("a", "d", None), (None, "e", "p")], "task string, domain string, prompt string")
    got = {r["log_pos"]: tuple(r)[1:] for r in evaluation.coding_rows(runs, tasks).collect()}
    assert got == {1: ("d", "", "It is [option], [interpretation]"), 2: ("UNKNOWN", "", ""), 3: ("UNKNOWN", "", "ok")}


def test_run_contrasts(spark):
    new = spark.createDataFrame([("a", "x", "H1_external", 0.5), ("b", "x", "H1_external", 0.7), ("c", "x", None, 0.9)], "task string, method string, regime string, cd_primary double")
    base = spark.createDataFrame([("a", "old", "H1_external", 0.2), ("z", "old", "H1_external", 0.9)], "task string, method string, regime string, cd_primary double")
    got = {(r["config"], r["regime"]): r for r in contrasts.run_contrasts(new, base, ["x", "y"], "old", 50).collect()}
    r = got["x", "H1_external"]
    assert (r["n_items"], r["n_delta"]) == (2, 1) and r["delta"] == pytest.approx(0.3) and r["lo"] == pytest.approx(0.3) and r["baseline_cd"] == pytest.approx(0.55)
    r = got["y", "H2_derivable"]
    assert (r["n_items"], r["n_delta"], r["delta"], r["lo"]) == (0, 0, None, None) and len(got) == 4


def test_reports_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None), ('say "hi", ok', 1.0, 2)], "name string, x double, n int")
    text = runlog.markdown(df.orderBy("x"), "Title", 1)
    assert text.startswith("## Title\n\n| name | x | n |\n|---|---|---|\n| a/b | 0.5000 | - |\n") and "more than 1 rows" in text
    runlog.write_sample(df, str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "s")).select("name", "x").collect())) == [("a|b", "0.5"), ('say "hi", ok', "1.0")]
    runlog.write_sample(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert runlog.first_existing([str(tmp_path / "none*")], str(tmp_path / "j")) == [str(tmp_path / "j")] and runlog.first_existing("/no/such*") == []
