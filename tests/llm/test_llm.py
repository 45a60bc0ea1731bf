"""The llm operators against brute force and on edge cases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensio.llm import catalogue, cutoffs, endings, leaks, packing, pairs, spam
from tests.compare import compare, connect

FOLDER = os.environ.get("CONSENSIO_TABLES", "/root/testdata/sf0.001")
PROSE = "The limit of 46 is applied before the rounding rule. Each entry is counted once, even when it repeats."


# 1: truncation


@pytest.mark.parametrize(
    "text",
    [
        "The limit of 46 is appl", "The limit of 46 is applied before the", "We dropped 4 trials,", "```python\ndef f(x):\n    return [x for x in", "<think>\nFirst I multiply 5 by 6.", "The run log writes one line and never…",
        "x = 5. The run log writes one li [+212 chars]", "def f(a):\n    step = 3\n    return '%.2f' % (a *", "Each invoice line is counted onc�", "```py\ndef f(", "**Answer: 20", "每一条电表读数只计", "1. First step.\n2.", "The steps are short [truncated]",
    ],
)
def test_cut_endings(text):
    assert endings.ending_evidence(text) >= endings.CUT


@pytest.mark.parametrize(
    "text",
    ["42", "Q3", "**145**", "[36, 54]", "ok thanks", PROSE, "```python\ndef f(x):\n    return x + 1\n```", "<think>short</think>\n\n7", "def f(x):\n    return x * 2 + 1", "每一条电表读数只计算一次。", '"quoted answer."', "He said so (see page 3).", "None"],
)
def test_whole_endings(text):
    assert endings.ending_evidence(text) < 0


@pytest.mark.parametrize("text", [None, "", " \n\t", "​"])
def test_blank_has_no_ending(text):
    assert endings.ending_evidence(text) is None


def test_a_long_text_is_read_whole():
    assert endings.ending_evidence("```\n" + "x = 1\n" * 100_000 + PROSE) == endings.STRONG


def test_censored_fit_recovers_parameters():
    rng = np.random.default_rng(0)
    x = np.minimum(np.round(np.exp(rng.normal(5, 0.5, 40_000))), 200)
    v, n = np.unique(x, return_counts=True)
    mu, sd = endings.fit_censored(v, n, 200)
    assert mu == pytest.approx(5, abs=0.03) and sd == pytest.approx(0.5, abs=0.03)
    found = endings.censoring(v, n)
    assert [k for k, _ in found] == [200] and found[0][1] > 0.9
    free, m = np.unique(np.round(np.exp(rng.normal(5, 0.5, 40_000))), return_counts=True)
    assert not endings.censoring(free, m)


def texts(spark, rows):
    return spark.createDataFrame(rows, "text string, endpoint string, model string, tokens int").select("*", F.monotonically_increasing_id().alias("row_key"), F.lit("t").alias("origin"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def test_limits_decide_doubtful_endings(spark):
    rng = random.Random(0)
    body = [(PROSE[: 20 + rng.randrange(60)] + ".", "e", "m", None) for _ in range(300)]
    cut = [("word " * 24 + "It leaves 655.", "e", "m", None)] * 60
    got = endings.with_cut(texts(spark, body + cut + [(None, None, None, None), ("", "e", "m", 5)]), F.col("text")).groupBy("is_cut").count().collect()
    assert {r["is_cut"]: r["count"] for r in got} == {True: 60, False: 302}
    assert endings.with_cut(texts(spark, []), F.col("text")).count() == 0
    # without the limits none of them is
    judged = endings.with_cut(texts(spark, body + cut), F.col("text"))
    assert judged.where("is_cut AND p_limit > 0.5").count() == 60 and judged.where(F.col("evidence") > -math.log(endings.BASE_RATE / (1 - endings.BASE_RATE))).count() == 0


def test_common_last_lines_are_learned(spark):
    rng = random.Random(11)
    # in a language that no list knows: a line of certainty ends every text, and some texts are cut within it
    def body():
        return "word " * rng.randrange(5, 60) + "end."

    whole = [(f"{body()}\n\nGewisz: {rng.randrange(10, 100)}.{rng.randrange(10, 100)} pct", "e", "m", None) for _ in range(3000)]
    broken = [(f"{body()}\n\nGewisz: {rng.randrange(10, 100)}{tail}", "e", "m", None) for tail in (".", ".4", " p", ".37 pc", "") for _ in range(4)]
    got = endings.with_cut(texts(spark, whole + broken), F.col("text")).groupBy(F.col("text").endswith("pct").alias("whole"), "is_cut").count().collect()
    assert {(r["whole"], r["is_cut"]): r["count"] for r in got if r["whole"]} == {(True, False): 3000}
    assert sum(r["count"] for r in got if not r["whole"] and r["is_cut"]) >= 16
    forms = {t: f for t, f in spark.createDataFrame([("a\n Gewisz: 72.50 PCT \n",), ("gewisz: 9.13 pct",), ("gewisz: 9.1 pct",), ("x" * 99,), ("",), (None,)], "t string").select("t", endings.form_of(F.col("t"))).collect()}
    assert forms["a\n Gewisz: 72.50 PCT \n"] == forms["gewisz: 9.13 pct"] != forms["gewisz: 9.1 pct"] and forms["x" * 99] is None and forms[""] is None and forms[None] is None


# 5: pairs

PROMPT = "Report the typical value of the deposit slip data [68, 12, 8] as a string.\n\nBounds are inclusive at the lower end only."


@pytest.mark.parametrize(
    ("output", "want"),
    [
        (None, "empty"), ("", "empty"), ("​", "empty"), ("N/A", "empty"), ("<answer></answer>", "empty"), ("```\n\n```", "empty"), ("<think>long reasoning here</think>", "empty"), ("[no output]", "empty"), ('""', "empty"),
        (PROMPT, "copy"), ("> " + PROMPT.split("\n")[0], "copy"), (PROMPT.upper(), "copy"), ("Task:\n" + PROMPT.lower() + "\n\nAnswer:", "copy"), (PROMPT + "\n\nConfidence: 54%", "copy"),
        ("I'm sorry, but I can't help with this request.", "refusal"), ("```\nI must decline to write this function.\n```", "refusal"), ("Tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("I won’t be computing this because it could be misused.", "refusal"),
        ("Ich gehe Schritt für Schritt vor. Die Schleife summiert die Einträge und rundet erst am Ende.", "language"), ("我逐步计算。每一条工资单只计算一次。最后再进行四舍五入。", "language"),
        ("42", None), ("Q2", None), (PROMPT.split("\n")[0] + "\n\nThe result is 12.50.", None), ("I'm sorry about the earlier mix-up; this version is corrected. The result is 5.", None),
        ("I can't see the contract itself, so I take the usual rule and carry on. The loop adds up the entries and rounds only at the end.", None), ('The form says: "Die Schleife summiert die Einträge und rundet erst am Ende." I keep to that. The value is 7 and it is final.', None),
        ("def f(x):\n    return x * 2 + 1", None), ("```python\ndef f(x):\n    return x\n```", None),
    ],
)
def test_defects(output, want):
    assert pairs.defect(PROMPT, output, 0) == want


def test_defects_that_are_cut():
    assert pairs.defect(PROMPT, "The result of the fir", 1) == "truncated"
    assert pairs.defect(PROMPT, PROMPT[:60], 1) == "copy"
    assert pairs.defect(None, "x y", 0) is None and pairs.defect(None, "", 0) == "empty"


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        least = rng.randrange(1, 4)
        want = [False] * len(b)
        for i in range(len(b)):
            for j in range(i + least, len(b) + 1):
                if any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                    want[i:j] = [True] * (j - i)
        assert pairs.SuffixAutomaton(a).copied(b, least) == want


# 7: leaks


def passage(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_leaks_equal_what_was_planted():
    rng = random.Random(2)
    items = [(f"i{k}", passage(rng, 60)) for k in range(20)]
    docs, want = [], set()
    for d in range(300):
        k = rng.randrange(20)
        ws = items[k][1].split()
        kind = d % 5
        if kind == 0:  # whole
            part = " ".join(ws).upper()
        elif kind == 1:  # 24 words, with marks and one word in eight changed
            at = rng.randrange(30)
            part = [*ws[at : at + 24]]
            for x in (6, 12, 18):
                part[x] = "other"
            part = "> " + "\n> ".join(" ".join(part[i : i + 5]) for i in range(0, 24, 5))
        elif kind == 2:  # too short
            part = " ".join(ws[5:17])
        else:
            part = ""
        if kind < 2:
            want.add((d, items[k][0]))
        docs.append(f"{passage(rng, 40)} {part} {passage(rng, 40)}")
    got = leaks.search(leaks.Items(items), docs)
    assert {x[:2] for x in got} == want
    for d, i, at, n in got:  # the longest verbatim match, by brute force
        doc, item = leaks.words(docs[d]), leaks.words(dict(items)[i])
        assert doc[at : at + n] in [item[k : k + n] for k in range(len(item))]
        assert not any(doc[k : k + n + 1] == item[j : j + n + 1] for k in range(len(doc) - n) for j in range(len(item) - n))


def test_suffix_array_equals_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        n, least, gaps = rng.randrange(1, 60), rng.randrange(1, 4), [0] * leaks.STEP
        flat = np.array([rng.randrange(4) for _ in range(n)] + gaps, np.int32)
        text = np.array([rng.randrange(4) for _ in range(12)] + gaps, np.int32)

        def suffix(x, p):
            end = p + int(np.argmin(x[p:] > 0))
            return x[p:end].tolist()

        def run(p):
            while p and flat[p - 1]:
                p -= 1
            return len(suffix(flat, p))

        array, places = leaks.SuffixArray(flat, least), [p for p in range(n) if flat[p] and run(p) >= least]
        assert sorted(array.at.tolist()) == places
        assert [suffix(flat, p) for p in array.at] == sorted(suffix(flat, p) for p in places)
        q = np.flatnonzero(text)
        for k, best in zip(q, array.longest(text, q)):
            own = suffix(text, int(k))
            assert best == max([j for p in places for j in range(len(own) + 1) if suffix(flat, p)[:j] == own[:j]], default=0)


MOULD = "a choir rents {} chairs from port town of which {} are returned unopened by july so divide the rest among {} owners and list the {} largest in order"


def test_what_only_shares_a_mould_is_no_leak(spark):
    rng = random.Random(3)
    moulded = [MOULD.format(*[1000 + 4 * k + j for j in range(4)]) for k in range(6)]
    twin = passage(rng, 40)
    items = spark.createDataFrame([*[(f"m{k}", t) for k, t in enumerate(moulded)], ("t1", twin), ("t2", twin), ("n", None)], "item_id string, text string")
    own = {r["_key"]: [w for k, w in enumerate(leaks.words(r["_text"])) if k not in r["_mould"]] for r in leaks.own_words(items, "item_id", "text").collect()}
    assert own["m0"] == ["1000", "1001", "1002", "1003"] and len(own["t1"]) == 40 and "n" not in own
    docs = [MOULD.format(7001, 7002, 7003, 7004), moulded[2].replace("chairs", "benches").replace("july", "may"), twin.replace(twin.split()[9], "x"), "<p>" + moulded[4].replace(" ", "&nbsp;") + "</p>", moulded[3].replace("chairs", "cha-\nirs"), moulded[1].replace("o", "о")]
    got = leaks.leaked(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), "doc_id", "text", items, "item_id", "text")
    assert dict(got.dtypes)["doc_id"] == "int"
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, "m2"), (2, "t1"), (2, "t2"), (3, "m4"), (4, "m3"), (5, "m1")]


def test_figures_alone_decide_nothing():
    # three changed words are allowed in a passage of twenty, be they figures or not
    ws = [f"word{k}" for k in range(17)] + ["11", "22", "33"]
    changed = [*ws[:3], "99", *ws[3:7], "98", *ws[7:11], "97", *ws[11:17]]
    item = [*ws[:3], "11", *ws[3:7], "22", *ws[7:11], "33", *ws[11:17]]
    assert [x[:2] for x in leaks.search(leaks.Items([("a", " ".join(item))]), [" ".join(changed)])] == [(0, "a")]


def test_leaks_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 30_000, 0), (4, "one two three four five six", 0), (4, "one two three four five six", 0), (5, "so one two other four five six end", 1)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([("a", "one two three four five six"), ("b", None), ("c", ""), ("d", "x"), ("e", "five six end")], "item_id string, text string")
    got = leaks.leaked(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted(map(tuple, got.collect())) == [(3, "d", 0, 1), (4, "a", 0, 6), (4, "a", 0, 6), (5, "a", 4, 3), (5, "e", 5, 3)]
    assert sorted(r["doc_id"] for r in leaks.without(docs, "doc_id", got).collect()) == [1, 2]
    assert leaks.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leaks.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_items_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b c d e f g h"), (3, None), (4, " ")], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "one two three four five six"), ("b", "a b c d e f g")], "item_id string, text string")
    whole = sorted(map(tuple, leaks.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 10)
    monkeypatch.setattr(leaks, "SHARD_WORDS", 3)
    assert sorted(map(tuple, leaks.leaked(docs, "doc_id", "text", items, "item_id", "text").collect())) == whole == [(1, "a", 0, 6), (2, "b", 0, 7)]


# 4: cutoffs


def test_cutoffs_equal_sorting(spark):
    rng = random.Random(4)
    rows = [(k, round(rng.random() ** (k + 1), rng.choice([1, 2, 9]))) for k, n in ((0, 5000), (1, 700), (2, 3), (3, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "source int, score double").repartition(9)
    for mille in (0, 1, 333, 500, 999, 1000):
        got = cutoffs.select_cutoffs(df, "source", "score", {k: mille for k in range(5)})
        for k in range(4):
            s = sorted((v for kk, v in rows if kk == k), reverse=True)
            best = next(v for v in s if sum(x >= v for x in s) * 1000 >= mille * len(s))
            assert got[k] == (best, len(s), sum(x >= best for x in s)), (k, mille)
        assert 4 not in got
    assert cutoffs.select_cutoffs(df.limit(0), "source", "score", {0: 5}) == {}


# 6: packing


def brute_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                out.append(i)
                break
        else:
            room.append(capacity - s)
            out.append(len(room) - 1)
    return out


def test_tournament_equals_first_fit():
    rng = random.Random(5)
    for _ in range(100):
        sizes = sorted((rng.randrange(1, 50) for _ in range(rng.randrange(60))), reverse=True)
        assert packing.first_fit_decreasing(np.array(sizes, np.int64), 50).tolist() == brute_first_fit(sizes, 50)


def test_packs_are_whole_and_within_capacity(spark):
    rng = random.Random(6)
    sizes = spark.createDataFrame([(i, rng.choice([0, 1, 30, 99, 100, 101, 250, 1000])) for i in range(500)], "doc_id bigint, tokens bigint")
    got = packing.pack(sizes.repartition(5), "doc_id", "tokens", [("a", 100), ("b", 64)], group_docs=100).toPandas()
    for name, capacity in (("a", 100), ("b", 64)):
        own = got[got.pack_name == name]
        assert own.groupby("container").tokens.sum().max() <= capacity
        want = {r[0]: r[1] for r in sizes.collect() if r[1]}
        assert own.groupby("doc_id").tokens.sum().to_dict() == want
        split = own.groupby("doc_id").piece.count()
        assert all((split[d] > 1) == (want[d] > capacity) for d in want)
        assert len(own.container.unique()) <= 1.3 * sum(want.values()) / capacity + 10
    assert packing.pack(sizes.limit(0), "doc_id", "tokens", [("a", 100)]).count() == 0


def test_tokens(spark):
    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer")
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a" * 5000), (5, "hello world")]
    got = {r[0]: r[1] for r in packing.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got[1] == got[5] == 2 and got[2] == got[3] == 0 and got[4] > 100


# 8: spam

KEYS = ["meter app", "free rota", "loan interest", "prompt pack", "cheap ledger", "quick audit"]


def test_spam(spark):
    rng = random.Random(7)

    def listed(sep):
        return sep.join(f"{rng.choice(KEYS)} {rng.choice(['best', 'cheap', 'online', '2025'])}" for _ in range(80))

    places = ["Norrest", "Marrowby", "Eastvane", "Quillhaven", "Brackenford", "Dapplewick"]
    prose = [" ".join(f"The contract in {rng.choice(places)} pays {rng.randrange(900)} for each ticket that is above the limit of {rng.randrange(90)}, at least when it is {rng.choice(['closed', 'open', 'signed', 'late'])} in the {rng.choice(['spring', 'autumn', 'winter'])}." for _ in range(12)) for _ in range(60)]
    bad = [listed(", "), listed("\n"), listed(" | "), " ".join(f"#{rng.choice(KEYS).replace(' ', '')}" for _ in range(80)), "\n".join(f"https://x{rng.randrange(99)}.example/p/{rng.randrange(9999)}" for _ in range(40)), "\n".join(f"[{rng.choice(KEYS)}](www.x{rng.randrange(99)}.example/a)" for _ in range(40)), "Buy meter app and get meter app best. Need a meter app? The meter app beats any other meter app. " * 9]
    good = [*prose, prose[0] + "\n\nSee also\n- limits https://a.example/1\n- rules www.b.example/2", "a,b,c\n" + "\n".join(f"I{rng.randrange(4)},{rng.randrange(99)},0.{rng.randrange(999)}" for _ in range(40)), "\n".join(f"2024-01-{rng.randrange(10, 28)}T05:11 run seed={rng.randrange(99)} label=I{rng.randrange(4)}" for _ in range(30)), "\n".join(f"Agent {i}: I{i % 3}" for i in range(30)), "def f(x):\n    return [i for i in range(x)]\n\ndef g(y):\n    total = 0\n    return total", "42"]
    rows = [(i, t, "k") for i, t in enumerate([*bad, *good, None, "", " \n"])]
    got = {r["doc_id"]: r["spam_share"] for r in spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), "doc_id", "text").collect()}
    assert all(got[i] > 0.5 for i in range(len(bad))), got
    assert all(got[i] <= 0.5 for i in range(len(bad), len(bad) + len(good))), got
    assert len(got) == len(bad) + len(good)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, PROSE, 5), (2, None, 0)], "kind bigint, doc_lang string, total bigint")
    assert [r["kind"] for r in spam.spam(df, "kind", "doc_lang").collect()] == [1]
    assert [r["kind"] for r in packing.pack(df, "kind", "total", [("a", 10)]).collect()] == [1]
    with pytest.raises(ValueError, match="kind"):
        leaks.leaked(df, "kind", "doc_lang", df, "kind", "doc_lang")


def test_blocks_keep_everything():
    rng = random.Random(8)
    for _ in range(50):
        t = "".join(rng.choice(["word ", "Ende. ", "\n", "x" * 50, "。", " "]) for _ in range(rng.randrange(200)))
        assert "".join("".join(spam.blocks(t)).split()) == "".join(t.split())


def test_compression_decides(spark, monkeypatch):
    rng = random.Random(12)
    # without sentences both: distinct words in one, the same few over and over in the other
    names = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    rows = [(0, "\n".join(" ".join(rng.sample(names, 6)) for _ in range(25))), (1, "\n".join(" ".join(rng.choice(["meter app", "free rota", "cheap audit"]) for _ in range(3)) for _ in range(25)))]
    rows += [(k, " ".join(f"The contract in {n.title()} pays {rng.randrange(900)} for each ticket above the limit of {rng.randrange(90)}, at least when it is {m}." for n, m in zip(rng.sample(names, 12), rng.sample(names, 12)))) for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in spam.spam(df, "doc_id", "text").where("spam_share > 0.5").collect()] == [1]
    monkeypatch.setattr(spam, "REDUNDANT", 1e9)
    assert sorted(r["doc_id"] for r in spam.spam(df, "doc_id", "text").where("spam_share > 0.5").collect()) == [0, 1]


def test_long_lines_of_links(spark):
    rng = random.Random(13)
    one = " ".join(f'<a href="https://x{rng.randrange(99)}.made-up/p/{rng.randrange(9999)}">{rng.choice(KEYS)}</a>' for _ in range(60))
    assert spam.spam(spark.createDataFrame([(1, one)], "doc_id bigint, text string"), "doc_id", "text").first()["spam_share"] > 0.5


def test_spam_of_nothing(spark):
    assert spam.spam(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    compare(spark, connect(FOLDER), FOLDER, name, catalogue.QUERIES[name], catalogue.SQL.get(name))
