"""The dominant keyword of short blocks."""

import random
from collections import Counter

from consensio.llm.spam import _keyword


def test_short_block():
    ws = ["cheap", "watches"] * 3 + [f"word{chr(97 + i)}" for i in range(14)]
    assert _keyword(ws) == (("cheap", "watches"), 0.3)
    assert _keyword(["spam"] * 4 + [f"word{chr(97 + i)}" for i in range(9)])[0] == ("spam", "spam")


def test_exit_is_lossless():
    rng = random.Random(3)
    for _ in range(3000):
        ws = [f"word{rng.randrange(9)}" for _ in range(rng.randrange(3, 9))] + [f"other{i}" for i in range(rng.randrange(0, 25))]
        most = max(Counter(zip(ws, ws[1:])).values())
        assert (_keyword(ws)[0] is not None) == (most >= 3)
