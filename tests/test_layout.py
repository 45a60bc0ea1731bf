"""The library does not need the llm folder."""

import pathlib
import re


def test_nothing_imports_the_llm_folder():
    root = pathlib.Path(__file__).resolve().parent.parent
    for p in (root / "consensio").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\s+consensio\.llm", p.read_text(), re.M), p
