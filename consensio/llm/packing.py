"""Queries p6_: texts packed into containers of fixed capacity.

Documents are thrown into groups at random, and each group is packed by first-fit decreasing: items in
falling order go into the first container with room, found in a tournament tree over the containers' room.
Only sizes are shuffled.
"""

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.operators.durable import cut
from consensio.sources.tables import table

#: Ranks of a public byte-level tokenizer; the folder may be set in CONSENSIO_TOKENIZERS.
TOKENIZER = os.path.join(os.environ.get("CONSENSIO_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: How that tokenizer splits a text before merging. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a group, on average.
GROUP_DOCS = 20_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of every document; 0 for null and empty texts. Whole texts are counted.

    The tokenizer's file lies on the driver and is sent along with the job.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(frames):
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "tokens": [len(encode(t)) if t else 0 for t in pdf[text]]})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, tokens bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size; sizes fall and none exceeds capacity."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [capacity] * (2 * width)  # room[1] is the root; leaves from width on
    out = np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        k = 1
        while k < width:
            k *= 2
            if room[k] < size:
                k += 1
        out[i] = k - width
        left = room[k] = room[k] - size
        while k > 1:
            other = room[k ^ 1]
            k >>= 1
            best = left if left > other else other
            if room[k] == best:
                break
            room[k] = left = best
    return out


def pack(sizes: DataFrame, key: str, tokens: str, capacities: list[tuple[str, int]], seed: int = 7, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Each document's pieces and their containers, for each named capacity.

    Returns pack_name, key, piece, tokens, container. A document longer than the capacity is split into full
    pieces and a rest; no other is split. Documents of no tokens (null and empty ones) take no container and
    are left out. Equal sizes are ordered by key, so the result is the same at every partitioning; keys must
    be unique, but repeated texts are packed like any other. `container` is unique within a pack. Groups are
    drawn by hash, so none grows with a source, and their number follows the number of documents.
    """
    groups = max(1, -(-sizes.count() // group_docs))
    packs = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities]))
    items = sizes.where(F.col(tokens) > 0).select(F.col(key).alias("_key"), F.col(tokens).alias("total"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(groups)).cast("int").alias("grp"), packs.alias("p")).select("_key", "total", "grp", "p.*")
    kind = dict(sizes.dtypes)[key]

    def run(group, pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, grp = group
        total = pdf["total"].to_numpy()
        pieces = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, total[row] - piece * capacity)
        keys = pdf["_key"].to_numpy()[row]
        order = np.lexsort((piece, keys, -size))
        box = first_fit_decreasing(size[order], int(capacity))
        return pd.DataFrame({"pack_name": name, key: keys[order], "piece": piece[order].astype(np.int32), "tokens": size[order], "container": int(grp) * 2**32 + box})

    return items.groupBy("pack_name", "capacity", "grp").applyInPandas(run, f"pack_name string, {key} {kind}, piece int, tokens bigint, container bigint")


def _capacities(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    """The rows of a small fixed table."""
    return [(r[0], r[1]) for r in table(spark, sf, "pack_sizes").where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").toLocalIterator()]


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = cut(count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "tokens", _capacities(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each pack, the fewest that could do, and the share of their room that is used."""
    capacities = _capacities(spark, sf)
    boxes = p6_packed(spark, sf).groupBy("pack_name", "container").agg(F.sum("tokens").alias("used"))
    capacity = F.element_at(F.create_map(*[x for n, c in capacities for x in (F.lit(n), F.lit(c))]), F.col("pack_name"))
    out = boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"))
    return out.withColumn("fewest", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6))


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report}
SQL: dict[str, str] = {}
