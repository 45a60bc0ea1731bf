"""Exactly one copy of records that were delivered at least once.

Every identity becomes a 64-bit hash. Hashes and time buckets, twelve bytes a row, are spread over
shards of the hash space after repeats within a batch are folded. Each shard reads its rows as a
stream and keeps one Bloom filter per time bucket: what no filter of any bucket knows is definitely
new and goes no further. For the rest, the pair of hash and bucket, and the pairs of the buckets whose
filters know it, are noted. The table is then read again, each row is tested where it is read against the noted
pairs, or a filter of them where they are many, and only matching rows are shuffled and compared by all columns of
their identity.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from consensio.operators.durable import cut, fits, salted_join

BITS_PER_ID = 16
#: Words of 64 bits of the filter that is sent to all executors at most; with more pairs it lets more rows pass, never fewer.
SENT_WORDS = 1 << 22
PROBES = 6
SHARD_ROWS = 2_000_000


class Bloom:
    """Blocked Bloom filters over 64-bit hashes, each twice as large as the one before, as many as are needed.

    All probes of a hash lie in one block of 512 bits.
    """

    def __init__(self, expected: int):
        self.room, self.free, self.parts = expected, 0, []

    @staticmethod
    def _at(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        h = h.view(np.uint64)
        block = ((h >> np.uint64(20)) & np.uint64(blocks - 1)).astype(np.int64)
        x = h * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        place = np.stack([(x >> np.uint64(9 * i)) & np.uint64(511) for i in range(PROBES)])
        return block * 8 + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.free:
                self.room *= 2 if self.parts else 1
                self.free = self.room
                self.parts.append(np.zeros(8 << max(4, int(np.ceil(np.log2(self.room * BITS_PER_ID / 512)))), np.uint64))
            some, h = h[: self.free], h[self.free :]
            at, bit = self._at(some, len(self.parts[-1]) // 8)
            np.bitwise_or.at(self.parts[-1], at.ravel(), bit.ravel())
            self.free -= len(some)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for words in self.parts:
            at, bit = self._at(h, len(words) // 8)
            found |= ((words[at] & bit) != 0).all(0)
        return found


def _fold(batches):
    """Fold repeats within each Arrow batch; rows: hash, bucket, n."""
    for b in batches:
        if b.num_rows:
            t = pa.table(b).group_by(["shard", "h", "bucket"]).aggregate([([], "count_all")])
            yield from t.select(["shard", "h", "bucket", "count_all"]).rename_columns(["shard", "h", "bucket", "n"]).to_batches()


def _screen(expected: int):
    def run(batches):
        filters: dict[int, Bloom] = {}
        for b in batches:
            h, bucket, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h", "bucket", "n"))
            if not len(h):
                continue
            # A hash may come several times in one batch, from several mappers: all but the first are known.
            order = np.lexsort((bucket, h))
            h, bucket, n = h[order], bucket[order], n[order]
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[:-1] |= again[1:]
            own = again | (n > 1)
            found = []
            for k, bloom in filters.items():
                hit = bloom.may_hold(h)
                own |= hit
                if hit.any():
                    found.append((h[hit], np.full(hit.sum(), k, np.int32), np.zeros(hit.sum(), np.int64)))
            if own.any():
                found.append((h[own], bucket[own].astype(np.int32), n[own]))
            for k in np.unique(bucket):
                filters.setdefault(int(k), Bloom(expected)).add(h[bucket == k])
            if found:
                h, bucket, n = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["h", "bucket", "n"])

    return run


def possible_repeats(rows: DataFrame, total: int, buckets: int) -> DataFrame:
    """Pairs (h, bucket, n) of identities that may occur more than once; rows: h BIGINT, bucket INT.

    n is the number of rows of the pair that were seen as repeats, and at least that of any hot pair's
    rows less one. No pair of a repeated identity is missing; a few of new ones are there by chance.
    """
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    expected = max(256, total // shards // max(1, buckets))
    folded = rows.withColumn("shard", F.pmod(F.shiftright("h", 40), F.lit(shards)).cast("int")).mapInArrow(_fold, "shard int, h bigint, bucket int, n bigint")
    noted = folded.repartition(shards, "shard").mapInArrow(_screen(expected), "h bigint, bucket int, n bigint")
    return noted.groupBy("h", "bucket").agg(F.sum("n").alias("n"))


def matching(store: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of store (h, bucket, ...) whose pair is in pairs (h, bucket, n).

    Pairs that fit are sent to the scan. Of more pairs a filter is, of SENT_WORDS words at most, built by aggregation; what passes
    it is joined with the pairs, hot ones salted.
    """
    if fits(pairs):
        return store.join(F.broadcast(pairs.select("h", "bucket")), ["h", "bucket"], "left_semi")
    size = 8
    while size < SENT_WORDS and size * 64 < pairs.count() * BITS_PER_ID:
        size *= 2

    def bits(batches):
        for b in batches:
            at, bit = Bloom._at(b.column("h").to_numpy(zero_copy_only=False), size // 8)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(bit.ravel().view(np.int64))], names=["at", "bit"])

    words = np.zeros(size, np.uint64)
    own = pairs.select("h").mapInArrow(bits, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("w")).toPandas()  # SENT_WORDS rows at most
    words[own["at"]] = own["w"].to_numpy(np.int64).view(np.uint64)
    sent = store.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(BooleanType())
    def may_match(h: pd.Series) -> pd.Series:
        at, bit = Bloom._at(h.to_numpy(), size // 8)
        return pd.Series(((sent.value[at] & bit) != 0).all(0))

    return salted_join(store.where(may_match("h")), pairs.select("h", "bucket"), ["h", "bucket"], hot, "left_semi")


def surplus_rows(df: DataFrame, identity: dict[str, Column], position: str, time: str) -> DataFrame:
    """Rows of df whose identity also occurs at a smaller `position`, with the position that is kept.

    identity: name -> normalised column; a row with a null in any of them has no identity and is never
    surplus. position must be unique. `time` names the timestamp by whose month the storage is bucketed;
    it only steers the work, copies in different buckets (null is one) are found too. Returns `position`
    and `kept_at`. An empty table gives no rows. Ties cannot occur. Extra columns of df are not read, and names
    that clash with `identity` are no matter, as only its columns are used. An identity that holds a
    third of all rows is folded before each shuffle and salted in each join.
    """
    names = [f"_id{i}" for i in range(len(identity))]
    store = df.select(F.col(position).alias("_pos"), *[c.alias(n) for n, c in zip(names, identity.values())], F.coalesce(F.year(time) * 12 + F.month(time), F.lit(0)).cast("int").alias("bucket"))
    store = store.dropna(subset=names).withColumn("h", F.xxhash64(*names))
    total, buckets = store.agg(F.count(F.lit(1)), F.approx_count_distinct("bucket")).first()
    pairs = cut(possible_repeats(store.select("h", "bucket"), total, buckets))
    hot = pairs.where(F.col("n") >= max(100, total / 2000)).select("h", "bucket")
    doubtful = cut(matching(store, pairs, hot))
    # exact: by all columns of the identity
    kept = doubtful.groupBy("h", *names).agg(F.min("_pos").alias("kept_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = kept.where(F.col("n") >= max(100, total / 2000)).select("h").distinct()
    copies = salted_join(doubtful, kept.withColumnsRenamed({n: f"_k{n}" for n in names}).drop("n"), ["h"], hot, "inner")
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"_k{n}"))
    return copies.where(same & (F.col("_pos") > F.col("kept_at"))).select(F.col("_pos").alias(position), "kept_at")


def keep_first(df: DataFrame, identity: dict[str, Column], position: str, time: str) -> DataFrame:
    """df without its surplus rows (see surplus_rows); positions are unique, so the anti-join has no hot key."""
    return df.join(surplus_rows(df, identity, position, time).select(position), position, "left_anti")
