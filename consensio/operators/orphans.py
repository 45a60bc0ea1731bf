"""References to records that do not exist, or did not when they were made."""

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensio.operators.durable import fits, hot_keys, salted_join

#: Targets of at most so many rows are broadcast; beyond, both sides are shuffled and hot keys salted.
BROADCAST_ROWS = 100_000


def orphans(refs: DataFrame, targets: DataFrame, on: dict[str, str], *, match: str = "simple", at: str | None = None, born: str | None = None, gone: str | None = None) -> DataFrame:
    """Rows of refs whose composite key names no row of targets.

    on: column of refs -> column of targets, both normalised before. References are grouped by which of
    their key columns are null, and each group is anti-joined on the others:

    * match='simple': a reference with any null refers to nothing and is no orphan;
    * match='partial': its non-null columns must be those of some target; all null refers to nothing;
    * match='full': as 'simple' if all are null, but a reference with only some nulls is an orphan.

    With `at` (a time of refs), a target counts only if not `born` after that time and not `gone` at or
    before it; a null time, birth or end excludes nothing. Targets with a null key column are named by
    no reference that has that column. Repeated references come out repeatedly, repeated targets count once.
    No targets: every reference is an orphan. Columns of targets are renamed, so clashing names are no matter.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    keys = list(on)
    times = {n: c for n, c in (("_born", born), ("_gone", gone)) if c}
    side = targets.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(on.values())], *[F.col(c).alias(n) for n, c in times.items()]).distinct()

    def live(time: str | None) -> Callable:
        def condition():
            ok = F.lit(True)
            if time and born:
                ok = ok & ~F.coalesce(F.col("_born") > F.col(time), F.lit(False))
            if time and gone:
                ok = ok & ~F.coalesce(F.col("_gone") <= F.col(time), F.lit(False))
            return ok

        return condition

    out = []
    small = fits(targets.select(*on.values(), *times.values()), BROADCAST_ROWS)
    for mask in product([False, True], repeat=len(keys)):  # True: the column is null
        if all(mask) or (any(mask) and match == "simple"):
            continue
        own = refs
        for k, null in zip(keys, mask):
            own = own.where(F.col(k).isNull() if null else F.col(k).isNotNull())
        if any(mask) and match == "full":
            out.append(own)
            continue
        used = [i for i, null in enumerate(mask) if not null]
        to = side.dropna(subset=[f"_t{i}" for i in used])
        if small:
            on_key = live(at)()
            for i in used:
                on_key = on_key & (F.col(keys[i]) == F.col(f"_t{i}"))
            out.append(own.join(F.broadcast(to), on_key, "left_anti"))
        else:
            to = to.select(*[F.col(f"_t{i}").alias(f"_k{i}") for i in used], *times).distinct()
            own = own.withColumns({f"_k{i}": F.col(keys[i]) for i in used})
            names = [f"_k{i}" for i in used]
            out.append(salted_join(own, to, names, hot_keys(own.select(*names), names), "left_anti", condition=live(at)).drop(*names))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
