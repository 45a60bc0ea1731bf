"""Queries p7_: passages of held-out items inside documents.

Each shard of documents is one sequence of words; words that no item has are gaps. Its suffix array, in
full depth, is binary-searched for every suffix of every item, which gives the longest verbatim match of
each suffix and where it is. A match as long as a passage is a leak. Shorter ones that cannot be made
longer, of one item in one document and near one diagonal, are put together over changed words, and an
alignment of words decides.
"""

import difflib
import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.operators.durable import cut, fits, hot_keys, salted_join
from consensio.sources.tables import table

#: Words of a passage, of which at most one in CHANGED may be changed, added or missing.
PASSAGE_WORDS, CHANGED = 20, 6
#: Words of a seed. A passage of 20 words with 3 changes has at least MIN_SEEDS seeds of 4 words.
SEED, MIN_SEEDS, DRIFT = 4, 5, 4
#: Words in a shard's suffix array.
SHARD_WORDS = 1_000_000
#: Matches that are looked at together.
BLOCK_MATCHES = 4_000_000
#: Items are searched in blocks of about so many characters, each of which is sent to the executors.
BLOCK_CHARS = 8_000_000
#: Share of the items' texts, and at least two texts, above which a word in them is no item's own.
COMMON = 0.02
#: Words that are compared at a time.
STEP = 16
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>", re.S)
_HIDDEN = re.compile("[​‌‍⁠﻿­]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+(?:[.,'’:_][^\W_]+)*")
#: A word broken at the end of a line, with the marks of quotations and comments that the next line may begin with.
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n[ \t>#/*|;%]*(?=[^\W\d_])")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
#: Letters of other alphabets that look like Latin ones, and the Latin ones. Fixed values.
_LOOKS = "аеорсухіјѕԁһӏքԛԝвкмнтАВЕКМНОРСТУХІЈЅοαενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcyxijsdhlpqwbkmhtABEKMHOPCTYXIJSoaevikptuxABEZHIKMNOPTYX"
_ALIKE = str.maketrans(_LOOKS, _LATIN)
_ESCAPE = re.compile(r"\\[nrt\"\\/]")
_LATIN_LETTER = re.compile("[A-Za-z]")


def words(text: str) -> list[str]:
    """Words without letter case, punctuation, layout and markup; letters that only look Latin become so."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _LATIN_LETTER.search(text):
            text = unicodedata.normalize("NFKC", text).translate(_ALIKE)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "-" in text or "‐" in text:
        text = _HYPHEN.sub("", _BROKEN.sub("", text))
    return _WORD.findall(text.lower())


class Items:
    """Held-out items as sequences of word numbers; 0 is a gap.

    rows: (id, text, places of the words that are the item's own, see own_words; None: all of them).
    """

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.number: dict[str, int] = {}
        self.seqs = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(r[1])], np.int32) for r in rows]
        self.own = [np.ones(len(s), bool) for s in self.seqs]
        for r, own in zip(rows, self.own):
            if len(r) > 2 and r[2] is not None:
                own[:] = False
                own[np.asarray(r[2], np.int64)] = True
        self.size = np.array([len(s) for s in self.seqs], np.int64)
        self.start = np.cumsum([0, *(len(s) + STEP for s in self.seqs)])
        gap = np.zeros(STEP, np.int32)
        self.flat = np.concatenate([gap[:0], *(x for s in self.seqs for x in (s, gap))])
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.start))
        # a passage, and the longest match that every passage with changes is sure to have, up to a seed
        self.passage = np.minimum(self.size, PASSAGE_WORDS)
        changes = self.passage // CHANGED
        self.seed = np.minimum(SEED, -(-(self.passage - changes) // (changes + 1)))
        self.seeds = np.where(self.size >= PASSAGE_WORDS, MIN_SEEDS, 1)


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that a from i and b from j have in common before they differ or a gap comes; both end with STEP gaps."""
    out, on = np.zeros(len(i), np.int64), np.arange(len(i))
    steps = np.arange(STEP)
    while len(on):
        x, y = a[(i[on] + out[on])[:, None] + steps], b[(j[on] + out[on])[:, None] + steps]
        same = (x == y) & (x > 0)
        n = np.where(same.all(1), STEP, same.argmin(1))
        out[on] += n
        on = on[n == STEP]
    return out


class SuffixArray:
    """Suffixes of a sequence of words up to the next gap, in lexical order; those of runs of fewer than `least` words are left out.

    Sorted by prefix doubling: what still is equal after h words is sorted by the rank of what follows them.
    """

    def __init__(self, flat: np.ndarray, least: int):
        self.flat = flat
        gaps = np.flatnonzero(flat == 0)
        ends = np.repeat(gaps, np.diff(np.r_[-1, gaps]))  # the next gap at or after each place; flat ends with one
        first = np.r_[0, gaps + 1]
        long = np.repeat(np.diff(np.r_[first, len(flat) + 1]) - 1 >= least, np.diff(np.r_[first, len(flat) + 1]))[: len(flat)]
        at = np.flatnonzero(long & (flat > 0))
        at = at[np.argsort(flat[at], kind="stable")]
        rank = np.zeros(len(flat), np.int64)
        head = np.r_[True, flat[at][1:] != flat[at][:-1]] if len(at) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        rank[at] = lead + 1
        on, h = np.arange(len(at)), 1
        while len(on):
            # groups of suffixes equal so far; those that end here are equal for good
            groups, n = np.unique(rank[at[on]], return_counts=True)
            on = on[np.repeat(n > 1, n)]
            p = at[on]
            more = p + h < ends[p]
            key = (rank[p] << 32) | np.where(more, rank[np.minimum(p + h, len(flat) - 1)], 0)
            order = np.argsort(key, kind="stable")
            at[on], key, more = p[order], key[order], more[order]
            if not len(on):
                break
            head = np.r_[True, key[1:] != key[:-1]]
            lead = np.maximum.accumulate(np.where(head, on, 0))
            rank[at[on]] = lead + 1
            on = on[np.repeat(np.bitwise_or.reduceat(more, np.flatnonzero(head)), np.diff(np.r_[np.flatnonzero(head), len(on)]))]
            h *= 2
        self.at = at

    def place(self, text: np.ndarray, q: np.ndarray, depth: np.ndarray | None = None, after: bool = False) -> np.ndarray:
        """Where the suffixes of text at q would be inserted; with a depth, before or after all that share so many words."""
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.at))
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) // 2
            p = self.at[mid]
            n = common(text, q[on], self.flat, p)
            less = self.flat[p + n] < text[q[on] + n]
            if depth is not None:
                less = np.where(n >= depth[on], after, less)
            lo[on] = np.where(less, mid + 1, lo[on])
            hi[on] = np.where(less, hi[on], mid)
            on = on[lo[on] < hi[on]]
        return lo

    def longest(self, text: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the longest match of each suffix of text at q; it is with a neighbour of the suffix's place."""
        out = np.zeros(len(q), np.int64)
        if len(self.at):
            i = self.place(text, q)
            for k in (i - 1, i):
                ok = (k >= 0) & (k < len(self.at))
                out[ok] = np.maximum(out[ok], common(text, q[ok], self.flat, self.at[k[ok]]))
        return out


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, lo + n): the number of the range and the position of each of their members."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _aligned(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether doc has a passage of item of PASSAGE_WORDS words (the whole item if it is shorter) with few enough changes.

    Both ends of the passage must be kept words, else a shorter quotation would pass for a longer one.
    """
    n = min(PASSAGE_WORDS, len(item))
    allowed = n // CHANGED if n < PASSAGE_WORDS else PASSAGE_WORDS // CHANGED
    windows = np.lib.stride_tricks.sliding_window_view(item, n)
    far = np.int32(99)
    # distance of the windows' first k words to the best end at each word of doc
    best = np.where(windows[:, :1] == doc[None, :], np.int32(0), far)
    steps = np.arange(len(doc), dtype=np.int32)
    for k in range(1, n):
        same = windows[:, k : k + 1] == doc[None, :]
        shifted = np.full_like(best, far)
        shifted[:, 1:] = best[:, :-1]
        step = np.where(same, shifted, np.minimum(shifted, best) + 1)
        if k == n - 1:
            step = np.where(same, shifted, far)
            # words added before the last kept word are counted by the pass over the word before it
            return bool((step.min() if step.size else far) <= allowed)
        step = np.minimum.accumulate(step - steps, axis=1) + steps
        best = np.minimum(step, far)
    return bool(best.min() <= allowed) if best.size else False


def search(items: Items, texts: list[str]) -> list[tuple[int, str, int, int]]:
    """(number of the text, item, place, words) of all passages in a shard of texts, see search_words."""
    number = items.number
    return search_words(items, [np.fromiter((number.get(w, 0) for w in words(t)), np.int32) for t in texts])


def search_words(items: Items, docs: list[np.ndarray]) -> list[tuple[int, str, int, int]]:
    """(document, item, place, words) of all passages: where the longest verbatim match begins in the document, and its words.

    Of matches equally long, the first in the document.
    """
    start = np.cumsum([0, *(len(d) + STEP for d in docs)])
    flat = np.zeros(start[-1] + STEP, np.int32)
    for s, d in zip(start, docs):
        flat[s : s + len(d)] = d
    if not len(items.ids) or not items.size.any():
        return []
    array = SuffixArray(flat, int(items.seed[items.size > 0].min()))
    q = np.flatnonzero(items.flat)
    length = array.longest(items.flat, q)
    seed = items.seed[items.owner[q]]
    q, seed = q[length >= seed], seed[length >= seed]
    lo = array.place(items.flat, q, seed)
    n = array.place(items.flat, q, seed, after=True) - lo
    # whole items at a time, so that all matches of an item in a document are together
    owner = items.owner[q]
    out = []
    for s, e in _groups(owner):
        i = int(owner[s])
        parts, a = [], s
        while a < e:  # as many suffixes at a time as have BLOCK_MATCHES matches
            b = a + max(1, int(np.searchsorted(np.cumsum(n[a:e]), BLOCK_MATCHES, "right")))
            parts.append(_maximal(items, array, q[a:b], lo[a:b], n[a:b]))
            a = b
        p, at = (np.concatenate(x) for x in zip(*parts))
        words_of = common(items.flat, at, flat, p)
        doc = np.searchsorted(start, p, "right") - 1
        out += _leaks_of(items, i, docs, doc, p - start[doc], at - items.start[i], words_of)
    return sorted((d, items.ids[i], place, k) for d, i, place, k in out)


def _maximal(items: Items, array: SuffixArray, q: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard and in the items of matches that cannot be made longer to the left."""
    which, k = _expand(lo, n)
    p, at = array.at[k], q[which]
    before, own = array.flat[p - 1], items.flat[at - 1]  # place 0 has the gap at the end before it
    left = (before != own) | (own == 0)
    return p[left], at[left]


def _leaks_of(items: Items, i: int, docs: list[np.ndarray], doc: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Leaks of one item from its matches of n words at word p of documents and q of the item."""
    # seeds on diagonals near one another
    diagonal = doc * (np.int64(1) << 40) + (p - q) + (np.int64(1) << 32)
    order = np.lexsort((p, diagonal))
    diagonal, doc, p, q, n = diagonal[order], doc[order], p[order], q[order], n[order]
    total = np.r_[0, np.cumsum(n - items.seed[i] + 1)]
    near = total[np.searchsorted(diagonal, diagonal + DRIFT, "right")] - total[np.searchsorted(diagonal, diagonal - DRIFT, "left")]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    longest = np.maximum.reduceat(n, first)
    likely = (longest >= items.passage[i]) | (np.maximum.reduceat(near, first) >= items.seeds[i])
    for s, e, verbatim in zip(first[likely], np.r_[first[1:], len(doc)][likely], (longest >= items.passage[i])[likely]):
        d, best = int(doc[s]), s + int(np.lexsort((p[s:e], -n[s:e]))[0])
        offsets = () if verbatim else np.unique((p - q)[s:e][near[s:e] >= items.seeds[i]])
        if verbatim or any(_kept(items.seqs[i], docs[d], int(o)) and _passage(items, i, docs[d], int(o)) for o in offsets):
            yield d, i, int(p[best]), int(n[best])


def _groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(0, int)
    return zip(cuts[:-1], cuts[1:])


def _kept(seq: np.ndarray, doc: np.ndarray, off: int) -> bool:
    """Whether enough words of some window of the item may be kept near a diagonal; a bound, never too low."""
    n = min(PASSAGE_WORDS, len(seq))
    pad = DRIFT + 1
    a = np.zeros(len(seq) + 2 * pad, np.int32)
    s = max(0, off - pad)
    part = doc[s : off + len(seq) + pad]
    a[s - (off - pad) : s - (off - pad) + len(part)] = part
    hit = np.zeros(len(seq), bool)
    for k in range(2 * pad + 1):
        hit |= a[k : k + len(seq)] == seq
    sums = np.convolve(hit, np.ones(n, int), "valid")
    return bool(sums.max(initial=0) >= n - n // CHANGED)


def _spans(item: list[int], doc: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """Passages of item that begin and end with kept words: start, end, changes, kept ranges."""
    blocks = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if m.size]
    for x in range(len(blocks)):
        changes = 0
        for y in range(x, len(blocks)):
            a, b, n = blocks[y]
            if y > x:
                changes += max(a - blocks[y - 1][0] - blocks[y - 1][2], b - blocks[y - 1][1] - blocks[y - 1][2])
            yield blocks[x][0], a + n, changes, [(k[0], k[0] + k[2]) for k in blocks[x : y + 1]]


def _passage(items: Items, i: int, doc: np.ndarray, off: int) -> bool:
    """Whether doc has a passage of item i, with changes, near a diagonal.

    Of the passage's words that are the item's own more than half must be kept: what only resembles an item, as
    another exercise from the same mould does, keeps the words of the mould.
    """
    seq, own = items.seqs[i], items.own[i]
    part = doc[max(0, off - 3 * DRIFT) : max(0, off + len(seq) + 3 * DRIFT)]
    if not _aligned(seq, part):
        return False
    for a, b, changes, kept in _spans(seq.tolist(), part.tolist()):
        if b - a >= min(PASSAGE_WORDS, len(seq)) and changes * CHANGED <= b - a:
            if 2 * sum(int(own[x:y].sum()) for x, y in kept) > own[a:b].sum():
                return True
    return False


def own_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """`_key`, `_text` and `_mould` of items: places of the words that are not an item's own but of a mould.

    Those stand before or after the same word in another item with another text, or are in more than two texts
    and COMMON of them. Only hashes are shuffled, hot ones salted.
    """

    def parts(frames):
        for pdf in frames:
            rows = []
            for t, x in zip(pdf["_t"], pdf["_text"]):
                ws = words(x)
                rows += [(t, k, True, f"{a} {b}") for k, (a, b) in enumerate(zip(ws, ws[1:]))] + [(t, k, False, a) for k, a in enumerate(ws)]
            yield pd.DataFrame(rows, columns=["_t", "q", "two", "part"])

    texts = items.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).dropna().withColumn("_t", F.md5("_text"))
    distinct = texts.select("_t", "_text").dropDuplicates(["_t"])
    most = max(2, int(distinct.count() * COMMON))
    of = cut(distinct.mapInPandas(parts, "_t string, q int, two boolean, part string").select("_t", "q", "two", F.xxhash64("two", "part").alias("h")))
    n = of.groupBy("h", "two", "_t").agg(F.lit(1).alias("n")).groupBy("h", "two").agg(F.sum("n").alias("n"))
    shared = n.where(F.col("n") > F.when(F.col("two"), 1).otherwise(most)).select("h")
    mould = salted_join(of, shared, ["h"], hot_keys(of, ["h"]), "left_semi")
    places = mould.select("_t", F.explode(F.when(F.col("two"), F.array(F.col("q"), F.col("q") + 1)).otherwise(F.array("q"))).alias("q")).groupBy("_t").agg(F.collect_set("q").alias("_mould"))
    return texts.join(places, "_t", "left").select("_key", "_text", F.coalesce("_mould", F.array().cast("array<int>")).alias("_mould"))


def _blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of about BLOCK_CHARS characters, which pass the driver one after the other."""
    rows, size = [], 0
    for k, text, mould in items.toLocalIterator():
        rows.append((k, text, np.setdiff1d(np.arange(len(words(text))), np.asarray(mould, np.int64))))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def _named(*names: str) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def normal(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs (key, text) with the words of the texts, one space between them; blank texts are left out."""

    def run(frames):
        for pdf in frames:
            pdf[text] = [" ".join(words(t)) for t in pdf[text]]
            yield pdf[pdf[text] != ""]

    return docs.where(_named(text)[0] != "").select(*_named(key, text)).mapInPandas(run, docs.select(*_named(key, text)).schema)


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, start: str = "match_start", n_words: str = "match_words") -> DataFrame:
    """(key, item_key, start, n_words) of documents that contain a passage of an item, and where its longest verbatim match is, in words.

    Items are a stated set of queries: they are read in blocks of BLOCK_CHARS characters, and every block is
    searched in all documents; for more than one block the documents' words are written once and read from there.
    Documents are not shuffled; a shard is what one task has read, up to SHARD_WORDS words at a time, and each
    document is a sequence of its own, so the result is the same at every partitioning. Null or blank texts and items
    match nothing; repeated documents each match. An item of fewer than PASSAGE_WORDS is found as a whole, with one word in CHANGED
    changed, so one of a single word is found wherever that word is. Keys may have any type; other columns are not read.
    """
    names = [key, item_key, start, n_words]
    if len(set(names)) < 4:
        raise ValueError(f"columns must differ: {names}")
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, (docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString(), "int", "int")))
    empty = docs.sparkSession.createDataFrame([], schema)
    kinds = [f.type for f in empty.toArrow().schema]
    blocks = _blocks(own_words(items, item_key, item_text))
    first = list(islice(blocks, 2))
    split = len(first) > 1
    source = cut(normal(docs, key, text)) if split else docs.select(*_named(key, text))

    def search_in(block: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            own, keys, seqs, total = sent.value, [], [], 0
            get = own.number.get

            def flush():
                hits = search_words(own, seqs)
                columns = [[keys[h[0]] for h in hits], *([h[k] for h in hits] for k in (1, 2, 3))]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if t:
                        ws = t.split(" ") if split else words(t)
                        seqs.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
                        keys.append(k)
                        total += len(ws)
                        if total >= SHARD_WORDS:
                            yield flush()
                            keys, seqs, total = [], [], 0
            if seqs:
                yield flush()

        return source.mapInArrow(run, schema)

    out = empty
    for i, block in enumerate([*first, *blocks] if split else first):
        out = search_in(block) if not i else out.unionByName(search_in(block))
    return out


def without(docs: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """docs without those that `leaks` (see leaked) names; documents with a null key stay, repeated ones go together."""
    hit = leaks.select(*_named(key)).distinct()
    if fits(hit, 100_000):
        hit = F.broadcast(hit)
    return docs.join(hit, key, "left_anti")


def _p7(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p7(spark, sf).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Where each leak is: first word and number of words of its longest verbatim match in the document."""
    return _p7(spark, sf)


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that each leaked item is in, and the longest match."""
    return _p7(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("match_words").alias("longest"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that remain, without their texts."""
    docs = table(spark, sf, "documents")
    return without(docs, "doc_id", cut(_p7(spark, sf))).select("doc_id", "source", "lang")


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches, "p7_items": p7_items, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
