"""The word lists before the patterns of abstention lose no match: each alternative of each pattern alone."""

import itertools
import re
from re import _parser as P

import pytest
from pyspark.sql import functions as F

from consensio.functions import text as X


def spelled(tree):
    """Shortest texts for every choice of alternatives of a parsed pattern."""
    parts = []
    for op, av in tree:
        if op is P.LITERAL:
            parts.append([chr(av)])
        elif op is P.BRANCH:
            parts.append([t for x in av[1] for t in spelled(x)])
        elif op is P.SUBPATTERN:
            parts.append(spelled(av[3]))
        elif op in (P.MAX_REPEAT, P.MIN_REPEAT):
            parts.append(spelled(av[2]) if av[0] else [" " if av[2][0][0] is P.ANY else ""])
        elif op is P.IN:
            parts.append([chr(av[0][1]) if av[0][0] is P.LITERAL else " " if av[0][1] is P.CATEGORY_SPACE else "x"])
        elif op in (P.ANY, P.NOT_LITERAL):
            parts.append(["x"])
        elif op is P.AT:
            parts.append([""])
        else:
            raise ValueError(op)
    return ["".join(t) for t in itertools.product(*parts)]


def test_indeterminate_is_no_commitment(spark):
    df = spark.createDataFrame([("The value is indeterminate.",)], "t string")
    assert df.select(X.abstention_signal(F.col("t"))).first()[0] == "CANNOT_DETERMINE"


@pytest.mark.parametrize("name", [n for n, _ in X.ABSTENTION])
def test_every_alternative_holds_a_needed_word(name):
    for p in dict(X.ABSTENTION)[name]:
        texts = spelled(P.parse(p, re.I))
        assert texts
        for t in texts:
            assert re.search(p, t, re.I), (p, t)
            assert any(w in t.lower() for w in X.NEEDED[name]), (p, t)


def test_shortcut_changes_nothing(spark, monkeypatch):
    texts = [t for _, ps in X.ABSTENTION for p in ps for t in spelled(P.parse(p, re.I))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    with_words = [r[0] for r in df.select(X.abstention_signal(F.col("t"))).collect()]
    monkeypatch.setattr(X, "_may", lambda text, name: F.lit(True))
    assert with_words == [r[0] for r in df.select(X.abstention_signal(F.col("t"))).collect()]
