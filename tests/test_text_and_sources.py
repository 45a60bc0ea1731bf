"""Text functions, readers and writers, and the stream of counts."""

import json

import pytest
from pyspark.sql import functions as F

from consensio.functions import text as X
from consensio.sources import runlog as S
from consensio.sources.runs import endpoint_guard, tidy_runs
from consensio.schema import TASK, bad_regimes
from consensio.streaming import counts as N


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "signal"),
    [
        ("I must abstain here.", "EXPLICIT_ABSTENTION"), ("It cannot be determined from this.", "CANNOT_DETERMINE"), ("I need more information.", "NEED_MORE_INFO"),
        ("Could you clarify which one?", "WHICH_MEAN"), ("What should I count?", "CLARIFICATION_QUESTION"), ("The prompt is ambiguous", "AMBIGUITY_FLAG"), ("Assuming the first interpretation: 5", "ASSUMING"),
        ("It clearly states which interpretation is intended, so the answer is I1", "CONFIDENT_COMMIT"), ("I do not know which", "CANNOT_DETERMINE"), ("42", "CONFIDENT_COMMIT"), ("", "CONFIDENT_COMMIT"), (None, "CONFIDENT_COMMIT"),
    ],
)
def test_abstention(spark, text, signal):
    assert one(spark, text, X.abstention_signal) == signal
    assert bool(one(spark, text, X.abstention_evidence)) == (signal != "CONFIDENT_COMMIT")


def test_masks_and_axes(spark):
    assert one(spark, "Interpretation I2 (narrow) or I1, I_perp", X.mask_labels) == "[interpretation] or [option], [interpretation]"
    df = spark.createDataFrame([("rounding rule", ["Which rounding rule applies?"]), ("rounding", ["Which rounding rule?"]), (None, ["x"]), ("bound", ["the bound"])], "d string, q array<string>")
    assert [r[0] for r in df.select(X.axis_match(F.col("d"), F.col("q"))).collect()] == [True, False, False, True]
    assert one(spark, "Programming Language", X.is_format_dimension) and not one(spark, "rounding", X.is_format_dimension)
    for values, want in ((["Python 3", "go"], True), (["Python", "half up"], False), ([], False), (None, False), (["R", None], False)):
        assert spark.createDataFrame([("target", values)], "n string, v array<string>").select(X.is_format_dimension(F.col("n"), F.col("v"))).first()[0] is want
    assert spark.createDataFrame([(None, ["c"])], "n string, v array<string>").select(X.is_format_dimension(F.col("n"), F.col("v"))).first()[0] is True


def test_amounts(spark):
    assert one(spark, "FINAL ANSWER: -$1,234.505", lambda t: X.agreed_amount(X.final_amounts(t))) == -123451
    assert one(spark, "FINAL ANSWER: 5\nFINAL ANSWER: 6", lambda t: X.agreed_amount(X.final_amounts(t))) is None
    assert one(spark, "FINAL ANSWER: 1,23", lambda t: X.agreed_amount(X.final_amounts(t))) is None
    assert one(spark, "FINAL ANSWER: (5)", lambda t: X.agreed_amount(X.final_amounts(t))) == -500
    assert one(spark, "none", lambda t: X.agreed_amount(X.final_amounts(t))) is None
    assert X.json_amounts_of('a {"amount": 5, "x": {"amount": "no"}} {"amount": 1e999}') == [5.0, None, None]


def test_reasoning_code_and_arrays(spark):
    assert X.strip_reasoning_text("<think>a<think>b</think>c</think>d") == "d"
    assert X.strip_reasoning_text("x <think>open") == "x" and X.strip_reasoning_text("lost</think>kept") == "kept"
    assert X.python_blocks_of("```python\na=1\n```\n```js\nb\n```\n```\nc=2\n```") == ["a=1", "c=2"]
    assert X.python_blocks_of("def f(): pass") == ["def f(): pass"] and X.python_blocks_of("not code at all") == []
    assert X.first_json_array_of('see [x] then [1, {"a": [2]}]') == '[1, {"a": [2]}]' and X.first_json_array_of("no") is None
    import hashlib

    assert one(spark, "abc", lambda t: X.sha_index(t, 7)) == int(hashlib.sha256(b"abc").hexdigest(), 16) % 7
    assert spark.range(1).select(X.row_id(F.lit("a"), F.lit(None), F.lit(3))).first()[0] == hashlib.sha1(b"a\x1f\x1f3").hexdigest()[:16]


def record(**k):
    return {"type": "run", "task_id": "t", "config": "single", "model_role": "agent", "model_id": "m", "output": "x", "label": "I0", "seed": 0} | k


def test_run_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join([json.dumps(record()), "{broken", "", json.dumps(record(label=" ")), json.dumps(record(task_id="other")), json.dumps({"_header": True}), json.dumps({"type": "cost_delta", "cost_usd": 0.5})]))
    log = S.read_run_log(spark, str(p))
    assert log.count() == 4
    tasks = spark.createDataFrame([("t",)], "id string")
    assert S.labelled_runs(log, tasks).count() == 1
    assert S.read_run_log(spark, str(tmp_path / "none*.jsonl")).columns == log.columns
    (tmp_path / "empty.jsonl").write_text("")
    assert S.read_run_log(spark, str(tmp_path / "empty.jsonl")).count() == 0


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(json.dumps(record(seed=s)),) for s in (0, 1, 1)], "v string").select(F.from_json("v", S.RUN_LOG).alias("r")).select("r.*").drop("_corrupt")
    ids = ["task_id", "config", "model_role", "model_id", "seed"]
    assert S.append_new(rows, path, ids) == 2
    assert S.append_new(rows, path, ids) == 0
    assert S.read_run_log(spark, path + "/*.json").count() == 2


def test_lines_shards_and_merge(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"_header": true, "_fingerprint": {"k": 1}}\n{"k": "x", "v": 1}\n{"k": "y", "v": 2}\n')
    b.write_text('{"_header": true, "_fingerprint": {"k": 1}}\n {"k": "x", "v": 1}\n')
    schema = S.StructType().add("k", "string").add("v", "integer")
    got = S.read_shards(spark, str(tmp_path / "*.jsonl"), schema, ["k"])
    assert got.count() == 3
    assert S.same_fingerprint(S.read_headers([str(a), str(b)]), ["k"]) == {"k": 1}
    S.write_merged(got.drop("shard"), ["k"], {"n": 2}, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text().count("\n") == 3
    assert S.union_lines(spark, [str(a), str(b)], schema).where("k IS NOT NULL").count() == 2
    b.write_text('{"v": 1}\n')
    with pytest.raises(ValueError, match="lacks"):
        S.read_shards(spark, str(tmp_path / "*.jsonl"), schema, ["k"])
    b.write_text('{"_header": true, "_fingerprint": {"k": 2}}\n')
    with pytest.raises(ValueError, match="differ"):
        S.same_fingerprint(S.read_headers([str(a), str(b)]), ["k"])
    with pytest.raises(FileNotFoundError):
        S.read_shards(spark, str(tmp_path / "no*"), schema, ["k"])


def test_tasks_trials_manifest(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": "a", "regime": "odd", "interpretations": [{"id": "I0", "is_target": True}]}) + "\n{bad\n")
    tasks = S.read_tasks(spark, str(tmp_path / "t.jsonl"))
    assert tasks.count() == 1 and tasks.schema == TASK and bad_regimes(tasks).count() == 1
    head = [f.name for f in S.TRIAL]
    rows = [dict.fromkeys(head, "") | {"participant_id": p, "condition": "fake", "accept": a, "passed_attention": "1", "order_index": str(i), "label": "01"} for p, n in (("p", 2), ("q", 1)) for i, a in enumerate(["1", "0"][:n])]
    (tmp_path / "c.csv").write_text(",".join(head) + "\n" + "\n".join(",".join(r[h] for h in head) for r in rows))
    kept = S.exclude_trials(S.read_trials(spark, str(tmp_path / "c.csv")), 2)
    assert kept.count() == 2 and kept.first()["label"] == "01" and S.trial_summary(kept).first()["accept_first"] == 1.0
    (tmp_path / "m.json").write_text('{"seeds": [3, 1, 3]}')
    assert S.requested_seeds(str(tmp_path / "m.json")) == [3, 1]
    (tmp_path / "m.json").write_text("{}")
    with pytest.raises(ValueError):
        S.requested_seeds(str(tmp_path / "m.json"))
    assert S.resolve_folder(tmp_path.name, str(tmp_path)) == str(tmp_path)


RUNS = "log_pos bigint, rec_type string, task_id string, config string, model_role string, model_id string, output string, label string, verbalized_conf double, logit_conf double, seed bigint, replicate_seed bigint, endpoint string"


def test_tidy_runs(spark):
    rows = [(1, "run", " T ", "Heterogeneous-MAD", "a", "m/x", "o", " I0 ", 0.5, None, None, None, None), (2, "run", "t", "single", "a", "m/x", "o", " ", 0.5, None, 1, None, "e"), (3, "run", "none", "single", "a", "m/x", "o", "I0", 0.5, None, 1, None, None), (4, "job_done", "t", "single", "a", "m/x", None, None, None, None, 1, None, None)]
    runs = spark.createDataFrame(rows, RUNS)
    tasks = spark.createDataFrame([("t", "d", None, None, [], 1, [], None)], TASK)
    got = tidy_runs(runs, tasks).collect()
    assert [(r["uid"], r["model_class"], r["seed"], r["target"], r["label"], r["regime"]) for r in got] == [(1, "heterogeneous", 0, "I0", "I0", None)]
    with pytest.raises(ValueError, match="several endpoints"):
        endpoint_guard(runs)
    assert endpoint_guard(runs, "e").count() == 1
    assert tidy_runs(runs.limit(0), tasks).count() == 0 and tidy_runs(runs, tasks.limit(0)).count() == 0


def test_stream_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    base = [("run", f"t{i % 3}", "single", "agent", "m", i % 2, f"I{i % 2}", f"2024-01-01 00:00:{i:02d}") for i in range(12)]
    df = spark.createDataFrame(base, "rec_type string, task_id string, config string, model_role string, model_id string, seed int, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(src)
    df.write.mode("append").parquet(src)  # everything is delivered twice
    stream = spark.readStream.schema(df.schema).parquet(src)
    N.keep_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["task_id"], r["seed"], r["label"]): r["n"] for r in N.present_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"t{t}", s, f"I{s}"): 1 for t in range(3) for s in range(2)}


def test_dimensions_are_cleaned(spark):
    dims = [(" unit ", ["a", " a", "b "]), ("", ["a", "b"]), (None, ["a", "b"]), ("one", ["a", "a", ""]), ("nulls", [None, "x", "y"]), ("none", None), ("last", ["1", "2"])]
    df = spark.createDataFrame([(dims,), (None,), ([],)], "d array<struct<dimension string, values array<string>>>")
    got = [r[0] for r in df.select(X.clean_dimensions(F.col("d"), 2)).collect()]
    assert [(d["dimension"], d["values"]) for d in got[0]] == [("unit", ["a", "b"]), ("nulls", ["x", "y"])] and got[1] is None and got[2] == []


def test_token_confidence(spark):
    import math

    rows = [([-0.1, -0.2, -0.3, -0.4, -0.5, -99.0],), ([-1.0, None],), ([],), (None,), ([None],)]
    got = [r[0] for r in spark.createDataFrame(rows, "l array<double>").select(X.token_confidence(F.col("l"))).collect()]
    assert [None if x is None else round(x, 9) for x in got] == [round(math.exp(-0.3), 9), round(math.exp(-1), 9), None, None, None]


def test_typed_and_structured_comparison(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-10), (1.0, 1.1), (None, None), (None, 0.0), (float("inf"), float("inf"))], "a double, b double")
    assert [r[0] for r in df.select(X.same_value(F.col("a"), F.col("b"), "double")).collect()] == [True, False, True, False, True]
    assert [r[0] for r in spark.createDataFrame([(1, 1), (None, None), (1, None)], "a int, b int").select(X.same_value(F.col("a"), F.col("b"), "int")).collect()] == [True, True, False]
    kinds = {"who": "string", "sum": "double", "n": "int"}
    df = spark.createDataFrame([((" Ada ", 1.001, 1), ("ada", 1.0, 1)), (("ada", 1.02, 1), ("ada", 1.0, 1)), (None, ("a", 1.0, 1)), ((None, None, None), (None, None, None))], "g struct<who string, sum double, n int>, w struct<who string, sum double, n int>")
    assert [r[0] for r in df.select(X.same_answer(F.col("g"), F.col("w"), kinds)).collect()] == [True, False, False, True]
