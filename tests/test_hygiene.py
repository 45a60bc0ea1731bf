"""Redelivery and orphans against brute force, with nulls, hot keys, ties, empty tables and clashing names."""

import datetime as dt
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensio.functions.keys import norm_endpoint, norm_key
from consensio.operators import orphans as O
from consensio.operators import redelivery
from consensio.operators.durable import hot_keys, salted_join
from consensio.operators.redelivery import Bloom, keep_first, surplus_rows

LOG = "pos bigint, a string, b bigint, ts timestamp, h bigint, bucket int, kept_at string"


def log(spark, n=3000, hot=0.35):
    rng, rows = random.Random(3), []
    for i in range(n):
        a = rng.choice(["X", " x\t", "x", None, ""]) if rng.random() < hot else f"k{rng.randrange(n)}"
        ts = dt.datetime(2024, 1 + rng.randrange(12), 1) if rng.random() < 0.9 else None
        rows.append((i * 7 % n if n % 7 else i, a, rng.choice([0, 1, None]) if rng.random() < 0.2 else 0, ts, 1, 2, "z"))
    return spark.createDataFrame(rows, LOG), rows


@pytest.mark.parametrize("many", [False, True])
def test_surplus_rows_equal_brute_force(spark, monkeypatch, many):
    if many:  # more doubtful pairs than are sent: a small filter
        monkeypatch.setattr(redelivery, "fits", lambda df: False)
        monkeypatch.setattr(redelivery, "SENT_WORDS", 64)
    df, rows = log(spark)
    got = {r[0]: r[1] for r in surplus_rows(df.repartition(7), {"a": norm_key("a"), "b": F.col("b")}, "pos", "ts").collect()}
    first, want = {}, {}
    for pos, a, b, *_ in sorted(rows, key=lambda r: r[0]):
        k = (a.strip().lower() if a else "", b)
        if not k[0] or b is None:
            continue
        if k in first:
            want[pos] = first[k]
        else:
            first[k] = pos
    assert got == want
    assert keep_first(df, {"a": norm_key("a"), "b": F.col("b")}, "pos", "ts").count() == len(rows) - len(want)


def test_surplus_rows_of_nothing(spark):
    df, _ = log(spark, 0)
    assert surplus_rows(df, {"a": norm_key("a")}, "pos", "ts").count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    bloom = Bloom(500)
    for part in np.array_split(h, 13):
        bloom.add(part)
    assert bloom.may_hold(h).all()
    assert bloom.may_hold(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.02


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_orphans_by_null_mask(spark, match, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    values = [None, "p", "q"]
    refs = [(i, a, b, dt.datetime(2024, 1, d)) for i, (a, b, d) in enumerate(product(values, values, (1, 5, 9)))] * 2
    targets = [("p", "q", dt.datetime(2024, 1, 2), None), ("p", "p", None, dt.datetime(2024, 1, 5)), ("q", None, None, None), ("p", "q", None, dt.datetime(2024, 1, 2))]
    r = spark.createDataFrame(refs, "i int, a string, b string, at timestamp").withColumn("x", F.lit(1))
    t = spark.createDataFrame(targets, "x string, b string, born timestamp, gone timestamp")
    got = sorted(row["i"] for row in O.orphans(r, t, {"a": "x", "b": "b"}, match=match, at="at", born="born", gone="gone").collect())

    def alive(t, at):
        return not (t[2] and t[2] > at) and not (t[3] and t[3] <= at)

    want = []
    for i, a, b, at in refs:
        key = [a, b]
        nulls = sum(k is None for k in key)
        if nulls == 2 or (nulls and match == "simple"):
            continue
        if nulls and match == "full":
            want.append(i)
            continue
        if not any(all(k is None or k == v for k, v in zip(key, t[:2])) and alive(t, at) for t in targets):
            want.append(i)
    assert got == sorted(want)


def test_orphans_without_targets_or_refs(spark):
    r = spark.createDataFrame([(1, "a"), (2, None)], "i int, k string")
    t = spark.createDataFrame([], "id string")
    assert [x["i"] for x in O.orphans(r, t, {"k": "id"}).collect()] == [1]
    assert O.orphans(r.limit(0), t, {"k": "id"}).count() == 0
    with pytest.raises(ValueError):
        O.orphans(r, t, {"k": "id"}, match="other")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(2000)], "i int, k string")
    right = spark.createDataFrame([(k, v) for k in ["hot", "k1", "k2", "none", None] for v in (1, 2)], "k string, v int")
    hot = hot_keys(left, ["k"], 10)
    assert [r[0] for r in hot.collect()] == ["hot"]
    got, want = salted_join(left, right, ["k"], hot, how), left.join(right, "k", how)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_keys(spark):
    rows = spark.createDataFrame([("  AbC　\n", "HTTPS://Gate.Example/V1//"), ("", None), (None, " "), (" \t", "http://x")], "k string, e string")
    got = rows.select(norm_key("k"), norm_endpoint("e")).collect()
    assert [tuple(r) for r in got] == [("abc", "https://gate.example/V1"), (None, ""), (None, ""), (None, "http://x")]
