"""What queries share: registration, rounding, and the tidy relation as SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensio.functions.keys import sql_norm_key as nk
from consensio.operators.resample import POISSON
from consensio.sources.runs import CONSTRUCTORS, MODEL_CLASSES


class Book:
    """Queries of a module and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = lambda spark, sf: rounded(f(spark, sf))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as sums of doubles depend on their order; a negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r6(sql: str) -> str:
    return f"(round(CAST({sql} AS DOUBLE), 6) + 0.0::DOUBLE)"


_CLASS = " ".join(f"WHEN model = '{m}' THEN '{k}'" for m, k in MODEL_CLASSES.items())
_BUILT = " ".join(f"WHEN starts_with(task, '{p}') THEN '{f}'" for p, f in sorted(CONSTRUCTORS.items(), key=lambda x: -len(x[0])))
TIDY = rf"""WITH task_facts AS (
  SELECT {nk('id')} AS task, coalesce(list_filter(interpretations, lambda x: x.is_target)[1].id, 'I0') AS target, regime, ambiguity_level AS ambiguity_k, domain, len(interpretations) AS n_interpretations, key_questions FROM tasks),
run_rows AS (
  SELECT log_pos AS uid, {nk('task_id')} AS task, {nk('config')} AS method, {nk('model_id')} AS model, {nk('model_role')} AS role, coalesce(replicate_seed, seed, 0) AS seed, trim(label) AS label, verbalized_conf AS conf, logit_conf, output
  FROM agent_runs WHERE rec_type = 'run' AND trim(label) <> ''),
tidy AS (
  SELECT r.*, CASE WHEN method = 'heterogeneous-mad' THEN 'heterogeneous' {_CLASS} WHEN contains(method, 'homogeneous') THEN 'homogeneous' ELSE 'unknown' END AS model_class, split_part(model, '/', 1) AS family,
    t.target, t.regime, t.ambiguity_k, t.domain, t.n_interpretations, CASE {_BUILT} END AS constructor_family
  FROM run_rows r JOIN task_facts t USING (task))"""
CELL_KEYS = "task, method, model_class, seed, regime, ambiguity_k"


def measures_sql(counts: str, keys: str) -> str:
    """Measures of cells from a relation of label counts, by the same definitions."""
    wrong, enum, en = "label <> target", "label <> target AND label <> 'I_perp'", "label <> 'I_perp'"
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}CAST(sum(n) AS BIGINT) AS n_agents, coalesce(max(n) FILTER ({wrong}), 0) * 1.0 / sum(n) AS cd_frozen, coalesce(max(n) FILTER ({enum}), 0) * 1.0 / sum(n) AS cd_primary,
  coalesce(coalesce(max(n) FILTER ({enum}), 0) * 1.0 / nullif(coalesce(sum(n) FILTER ({en}), 0), 0), 0) AS cd_drop_iperp, coalesce(sum(n) FILTER (label = 'I_perp'), 0) * 1.0 / sum(n) AS iperp_rate,
  CASE WHEN coalesce(sum(n) FILTER (label = target), 0) > coalesce(max(n) FILTER ({wrong}), 0) THEN 1 ELSE 0 END AS a_maj,
  coalesce(sum(n * (n - 1)) FILTER ({enum}), 0) * 1.0 / nullif(sum(n) FILTER ({enum}) * (sum(n) FILTER ({enum}) - 1), 0) AS pairwise_wrong,
  log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy, CASE WHEN count(label) > 1 THEN (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(label)) ELSE 0 END AS entropy_norm, max(n) * 1.0 / sum(n) AS consistency,
  CASE WHEN count(label) FILTER ({en}) > 1 THEN 1 - max(n) FILTER ({en}) * 1.0 / sum(n) FILTER ({en}) ELSE 0 END AS minority,
  CASE WHEN count(label) FILTER ({en}) > 1 THEN (log2(sum(n) FILTER ({en})) - sum(n * log2(n)) FILTER ({en}) / sum(n) FILTER ({en})) / log2(count(label) FILTER ({en})) ELSE 0 END AS divergence,
  CAST(coalesce(sum(n) FILTER ({en}), 0) AS BIGINT) AS n_enumerated, count(label) FILTER ({en}) AS k_enumerated, CAST(coalesce(sum(n) FILTER (label = 'I_perp'), 0) AS BIGINT) AS n_perp, CAST(coalesce(sum(n) FILTER (label = target), 0) AS BIGINT) AS n_target, CAST(coalesce(sum(n) FILTER ({enum}), 0) AS BIGINT) AS n_enum_wrong
FROM {counts} GROUP BY {keys if keys else 'ALL'}"""


LABELS = f"{TIDY}, lc AS (SELECT {CELL_KEYS}, target, label, count(*) AS n FROM tidy GROUP BY ALL)"
CELLS = f"{LABELS}, cells AS ({measures_sql('lc', CELL_KEYS)})"


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def weight_sql(seed: int, b: str, level: str) -> str:
    """The Poisson weight of a level in replicate b, see resample.weights."""
    bits = f"('0x' || substr(md5(concat_ws('|', '{seed}', CAST({b} // 4 AS VARCHAR), {level})), 1 + 8 * ({b} % 4), 8))::BIGINT"
    return f"len(list_filter({POISSON}, lambda t: t <= {bits}))"
