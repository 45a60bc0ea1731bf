"""Queries p4_: cutoffs that keep a target share of each source.

The cutoff of a source is one of its scores, of known rank. It is found by selection from many sorted
sequences: every partition keeps the sorted scores of each source as an array, written once; then, round
by round, a few pivots of each source are ranked by binary search in all arrays at once, and what lies
between the two pivots around the wanted rank is the range of the next round.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.functions.keys import norm_key
from consensio.functions.keys import sql_norm_key as nk
from consensio.operators.durable import cut, fits, hot_keys, salted_join
from consensio.sources.tables import table

#: Pivots of a source in a round; scores of a source, at even distances, from which they are taken.
PIVOTS, SAMPLED = 32, 4096
#: Scores that a task holds before it writes them as sorted arrays.
ARRAY_SCORES = 2_000_000


def sorted_arrays(scores: DataFrame, source: str, score: str) -> DataFrame:
    """The sorted scores of each source in each partition, in arrays of about ARRAY_SCORES at most: source, scores. Nothing is shuffled."""

    def run(frames):
        parts: dict[int, list[np.ndarray]] = {}
        held = 0

        def written():
            for k, own in parts.items():
                yield pd.DataFrame({source: [k], "scores": [np.sort(np.concatenate(own))]})
            parts.clear()

        for pdf in frames:
            for k, own in pdf.groupby(source)[score]:
                parts.setdefault(k, []).append(own.to_numpy())
            held += len(pdf)
            if held >= ARRAY_SCORES:
                yield from written()
                held = 0
        yield from written()

    return scores.select(source, score).mapInPandas(run, f"{source} int, scores array<double>")


def select_cutoffs(scores: DataFrame, source: str, score: str, per_mille: dict[int, int]) -> dict[int, tuple[float, int, int]]:
    """For each source its cutoff, its number of scores and how many of them are kept.

    scores: source INT, score DOUBLE, no nulls or NaN. The cutoff is the largest score at which the scores at
    or above it are at least per_mille / 1000 of the source's; ties at the cutoff are all kept, and at a share
    of nothing those at the largest score. Sources without scores are left out. State on the driver is one
    range for each source.
    """
    arrays = cut(sorted_arrays(scores, source, score))
    counts = {r[0]: r[1] for r in arrays.groupBy(source).agg(F.sum(F.size("scores"))).toLocalIterator() if r[0] in per_mille}
    rank = {k: max(1, -(-n * per_mille[k] // 1000)) for k, n in counts.items()}
    # open range of values (lo, hi) that holds the cutoff; how many scores are above lo, and how many at hi or above
    state = {k: (-np.inf, np.inf, n, 0) for k, n in counts.items()}
    done: dict[int, tuple[float, int, int]] = {}
    while state:
        now = dict(state)

        def propose(frames, now=now):
            for pdf in frames:
                out = []
                for k, a in zip(pdf[source], pdf["scores"]):
                    if k in now:
                        a = np.asarray(a)
                        lo, hi, above, beyond = now[k]
                        i, j = np.searchsorted(a, lo, "right"), np.searchsorted(a, hi, "left")
                        step = max(1, (above - beyond) // SAMPLED)
                        out.append(pd.DataFrame({source: k, "v": a[i + int(a[:1].view(np.uint64)[0] % np.uint64(step)) if j - i >= step else i : j : step]}))
                if out:
                    yield pd.concat(out)

        levels = F.array(*[F.lit((i + 0.5) / PIVOTS) for i in range(PIVOTS)])
        pivots = {r[0]: sorted(set(r[1])) for r in arrays.mapInPandas(propose, f"{source} int, v double").groupBy(source).agg(F.percentile_approx("v", levels, 100_000)).toLocalIterator()}

        def ranked(frames, pivots=pivots):
            for pdf in frames:
                out = []
                for k, a in zip(pdf[source], pdf["scores"]):
                    if k in pivots:
                        a, p = np.asarray(a), np.asarray(pivots[k])
                        out.append(pd.DataFrame({source: k, "p": p, "at_least": len(a) - np.searchsorted(a, p, "left"), "above": len(a) - np.searchsorted(a, p, "right")}))
                if out:
                    yield pd.concat(out)

        ranks = arrays.mapInPandas(ranked, f"{source} int, p double, at_least bigint, above bigint").groupBy(source, "p").agg(F.sum("at_least"), F.sum("above"))
        for k, p, at_least, above in ranks.toLocalIterator():
            if k not in state:
                continue
            lo, hi, above_lo, beyond = state[k]
            if above < rank[k] <= at_least:
                done[k] = (p, counts[k], at_least)
            elif above >= rank[k]:
                state[k] = (max(lo, p), hi, min(above_lo, above), beyond)
            else:
                state[k] = (lo, min(hi, p), above_lo, max(beyond, at_least))
        state = {k: v for k, v in state.items() if k not in done}
    return done


def counted(spark: SparkSession, sf: str, targets: list) -> DataFrame:
    """Results that count, once each: result_id, source (the place in targets), score."""
    results = table(spark, sf, "surfacing_results").where("score >= 0 AND score <= 1 AND NOT isnan(score) AND result_id IS NOT NULL")
    results = results.select("result_id", norm_key("task_id").alias("task"), "score").dropna(subset=["task"])
    results = results.groupBy("result_id").agg(F.min(F.struct("task", "score")).alias("r")).select("result_id", "r.*")
    places = spark.createDataFrame([(i, t["domain"], t["regime"]) for i, t in enumerate(targets)], "source int, d string, r string")
    tasks = table(spark, sf, "tasks").select(norm_key("id").alias("task"), "domain", "regime").dropna(subset=["task"])
    small = fits(tasks)
    # targets are on the driver, so they are few enough to be sent
    of = tasks.dropDuplicates(["task"]).join(F.broadcast(places), F.col("domain").eqNullSafe(F.col("d")) & F.col("regime").eqNullSafe(F.col("r"))).select("task", "source")
    if small:
        return results.join(F.broadcast(of), "task").select("result_id", "source", "score")
    return salted_join(results, of, ["task"], hot_keys(results, ["task"])).select("result_id", "source", "score")


def _selected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "keep_targets").dropna(subset=["keep_per_mille"]).distinct().collect()  # a row for each source; its state is one range on the driver
    scores = cut(counted(spark, sf, targets))
    found = select_cutoffs(scores, "source", "score", {i: t["keep_per_mille"] for i, t in enumerate(targets)})
    rows = [(i, targets[i]["domain"], targets[i]["regime"], float(c), int(n), int(k)) for i, (c, n, k) in sorted(found.items())]
    return scores, spark.createDataFrame(rows, "source int, domain string, regime string, cutoff double, n_counted bigint, n_kept bigint")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    scores, cutoffs = _selected(spark, sf)
    return scores.join(F.broadcast(cutoffs), "source").where("score >= cutoff").select("result_id")


def p4_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf)[1].drop("source")


_COUNTED = f"""SELECT r.result_id, r.score, t.domain, t.regime, k.keep_per_mille, count(*) OVER (PARTITION BY t.domain, t.regime) AS n,
  count(*) OVER (PARTITION BY t.domain, t.regime ORDER BY r.score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_least
FROM (SELECT DISTINCT result_id, {nk('task_id')} AS task, score FROM surfacing_results WHERE score >= 0 AND score <= 1 AND NOT isnan(score)) r
JOIN tasks t ON {nk('t.id')} = r.task JOIN keep_targets k ON k.domain = t.domain AND k.regime IS NOT DISTINCT FROM t.regime"""
_CUT = f"""SELECT domain, regime, n, min(at_least) AS n_kept, max(score) AS cutoff FROM ({_COUNTED}) WHERE at_least * 1000 >= keep_per_mille * n GROUP BY ALL"""

QUERIES = {"p4_found": p4_found, "p4_cutoffs": p4_cutoffs}
SQL = {
    "p4_found": f"SELECT c.result_id FROM ({_COUNTED}) c JOIN ({_CUT}) x ON c.domain = x.domain AND c.regime IS NOT DISTINCT FROM x.regime WHERE c.score >= x.cutoff",
    "p4_cutoffs": f"SELECT domain, regime, cutoff, n AS n_counted, n_kept FROM ({_CUT})",
}
