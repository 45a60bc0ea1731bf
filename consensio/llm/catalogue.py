"""All queries of the llm folder."""

from consensio.llm import cutoffs, leaks, packing, pairs, spam, truncation

_MODULES = [truncation, cutoffs, pairs, packing, leaks, spam]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
