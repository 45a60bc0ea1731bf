"""All queries outside the llm folder."""

from consensio.plans import consensus, evaluation, hygiene, logs, scalars, study

_MODULES = [consensus, evaluation, logs, scalars, hygiene, study]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
