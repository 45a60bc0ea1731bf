"""Queries p8_: documents that are spam of keywords, links or tags.

A document is cut into blocks. In a block, links and tags become one sign each, so that lists of them are
as repetitive as they look; the block's compression ratio is then compared with what blocks of its length
and language usually have. Blocks that are extremely redundant, and that have neither the punctuation of
sentences nor their function words, are spam; so is a document of which they are more than half. Code, figures
and lists of labels are redundant by nature and are left out.
"""

import math
import re
import zlib
from collections import Counter
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensio.llm.words import STOPWORDS
from consensio.operators.durable import cut
from consensio.sources.tables import table

#: Characters of a block at which the next line or sentence begins a new one.
BLOCK_CHARS = 400
#: Blocks whose log compression ratio is so many standard deviations below the usual one are redundant.
REDUNDANT = -2.5
#: Sentences per word, and share of function words, below which a block has no sentences.
SENTENCE_DENSITY, FUNCTION_WORDS = 0.04, 0.2
#: A pair of words that takes up this share of a block's words is a keyword it is stuffed with.
STUFFED = 0.2
#: A link counts with at most so many bytes, or a few of them would outweigh an article.
LINK_BYTES = 30
#: A document is spam if more than this share of it is.
SPAM_SHARE = 0.5

#: Generic domains that are links without a scheme or a path. Fixed values.
_GENERIC = "com|org|net|info|biz"
#: A host of letters and a top level of letters, with a path or a generic top level, is a link without a scheme.
_HOST = rf"(?<![\w@./-])(?:[a-z0-9][a-z0-9-]*\.)+(?:[a-z]{{2,24}}/[^\s<>\"')\]]+|(?:{_GENERIC})\b(?![\w.]))"
_LINK = re.compile(rf"<a\s[^>]*>.*?</a>|!?\[[^\]\n]{{0,120}}\]\((?:https?://|www\.)?[^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|{_HOST}", re.I | re.S)
_HASH = re.compile(r"(?<![\w#&])#[^\W\d_][\w-]*|(?<![\w#&])#\d+[^\W\d_][\w-]*")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?](?=[\s\"')\]”»]|$)|[。！？]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|for .*:$|while .*:$|if .*:$|else:|elif .*:$|try:|except\b.*:$|@\w|[\w.\[\]'\"]+(?:, ?\w+)* ?[-+*/]?= ?\S|[\w.]+\(.*\)\s*[:;]?$|[})\]]+;?$|//|/\*|#include|```|\{|function |var |let |const |SELECT )")
#: A line of a list of labels or of a table: a name, a mark and a value.
_LABEL = re.compile(r"^\s*[-*]?\s*(?:[\w .-]{1,40}[:=\t]\s*\S{1,40}$|[\w.-]+(?:[,;\t|] ?[\w.%+-]*\d[\w.%+-]*)+\s*$)")
_VOTES: dict[str, list[str]] = {}
for _k, _v in STOPWORDS.items():
    for _w in set(_v):
        _VOTES.setdefault(_w, []).append(_k)
_ZH = frozenset("的了是在不有和就都也而及与着或被把从这那其之于对")


_WEIGHT = dict.fromkeys(_VOTES, 1.0) | dict.fromkeys(_ZH, 2.5)
_DOMAIN = re.compile(_HOST, re.I)
_NO_DIGITS = dict.fromkeys(map(ord, "0123456789"))
_ENDS = ".!?。！？"


def blocks(text: str) -> list[str]:
    """text cut into blocks of about BLOCK_CHARS characters, at ends of lines and sentences; nothing is left out.

    A line without ends of sentences is cut at white space after that many characters.
    """
    out: list[str] = []
    for line in text.splitlines():
        line = line.strip()
        while len(line) > BLOCK_CHARS:
            m = _END.search(line, 60)
            end = m.end() if m else len(line)
            if end > BLOCK_CHARS + 100:
                end = line.find(" ", BLOCK_CHARS)
                if end < 0:
                    break
            out.append(line[:end])
            line = line[end:].lstrip()
        if line:
            out.append(line)
    return out


def joined(parts: list[str]) -> list[tuple[str, list[str]]]:
    """Parts in a row that are of one kind, as one block of that kind, up to twice BLOCK_CHARS characters."""
    out: list[tuple[str, list[str]]] = []
    size, last = 0, None
    for x in parts:
        kind = _kind(x)
        if kind == last and size + len(x) <= 2 * BLOCK_CHARS:
            out[-1][1].append(x)
            size += len(x)
        else:
            out.append((kind, [x]))
            size, last = len(x), kind
    return out


def _linked(text: str) -> bool:
    """Whether text may have links; quick."""
    return "://" in text or "www." in text or "](" in text or "<a" in text or "<A" in text or bool(_DOMAIN.search(text))


def _kind(line: str) -> str:
    if line[-1] in _ENDS and not _CODE.match(line):
        return "prose"  # until its words are known
    if _linked(line):
        return "other"
    return "label" if _LABEL.match(line) else "code" if _CODE.match(line) else "other"


def _function_share(ws: list[str]) -> float:
    """Share of function words; characters of Chinese count two and a half times, as a word is longer than one."""
    if not ws:
        return 0.0
    return sum(map(_WEIGHT.get, ws, repeat(0.0))) / len(ws)


def _keyword(ws: list[str]) -> tuple[tuple[str, str] | None, float]:
    """The pair of content words that recurs most, and the share of all words that it takes up."""
    if len(set(ws)) > len(ws) - 3:
        return None, 0.0  # a pair that recurs three times repeats three words or more
    pairs = Counter(zip(ws, ws[1:]))
    best, share = None, 0.0
    for (a, b), n in pairs.items():
        if n >= 3 and 2 * n / len(ws) >= share and len(a) > 2 and len(b) > 2 and a not in _VOTES and b not in _VOTES:
            if 2 * n / len(ws) > share or best is None or (a, b) < best:
                best, share = (a, b), 2 * n / len(ws)
    return best, share


def language(ws: list[str]) -> str:
    """Language of lower-case words by votes of their function words; '' if none has any."""
    n = {"en": 0, "de": 0, "fr": 0, "es": 0}
    for k in chain.from_iterable(filter(None, map(_VOTES.get, ws))):
        n[k] += 1
    if max(n.values()) < 0.1 * len(ws) and sum(1 for w in ws if len(w) == 1 and _CJK.match(w)) > 0.3 * len(ws):
        return "zh"
    best = max(n, key=n.get)
    return best if n[best] else ""


def block_facts(kind: str, lines: list[str]) -> tuple:
    """Of a block: its bytes, kind, language of its own words, log of its compression ratio, log2 of its bytes, share of links and tags, sentences per word, share of function words, words.

    What ends like a sentence but has too few words or function words, or is about the keyword alone, is none.
    """
    text = bare = "\n".join(lines)
    links, tags = [], []
    if _linked(text):
        links = [m[0] for m in _LINK.finditer(text)]
        bare = _LINK.sub(" \x01 ", text)
    if "#" in bare:
        tags = _HASH.findall(bare)
        bare = _HASH.sub(" \x02 ", bare)
    n_raw = len(text.encode())
    # deflate of few bytes has a fixed cost of about eleven
    size = max(1, len(zlib.compress(" ".join(bare.split()).encode(), 6)) - 11)
    share = (sum(map(len, links)) + sum(map(len, tags))) / max(1, len(text))
    if kind == "other":
        core = bare.strip()
        if len(core) - len(core.translate(_NO_DIGITS)) > 0.15 * max(1, len(core)):
            kind = "figures"
    low = bare.lower()
    segments, at = [], 0
    for m in _END.finditer(low):
        segments.append(_WORD.findall(low, at, m.end()))
        at = m.end()
    n_ends = len(segments)
    segments.append(_WORD.findall(low, at))
    ws = list(chain.from_iterable(segments))
    keyword, stuffed = _keyword(ws)
    stuffed = stuffed >= STUFFED
    n, weight = 0, 0.0
    for i, x in enumerate(segments):
        share_of = sum(map(_WEIGHT.get, x, repeat(0.0)))
        weight += share_of
        if i < n_ends and len(x) >= 4 and share_of >= FUNCTION_WORDS * len(x) and not (stuffed and keyword in zip(x, x[1:])):
            n += 1
    units = max(1, len(ws) + len(links) + len(tags))  # a link or a tag is as good as a word
    density, function = n / units, 0.0 if stuffed else weight / units
    if kind == "prose" and (function < FUNCTION_WORDS or len(ws) <= 4):
        kind = "other"
    n_bytes = len(bare.encode()) + sum(min(LINK_BYTES, len(x)) for x in links) + sum(map(len, tags))
    return n_bytes, kind, language(ws), math.log(size / max(1, n_raw)), int(math.log2(max(1, n_raw))), share, density, function, len(ws)


_FACTS = "n_bytes int, kind string, lang string, ratio double, size int, share double, density double, function double, n_words int"


def facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Facts of all blocks of all documents, with the language of the document; the key is in `_key`."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, t in zip(pdf["_key"], pdf["_text"]):
                if not t or not t.strip():
                    continue
                own = [block_facts(*x) for x in joined(blocks(t))]
                langs = [f[2] for f in own if f[2]]
                lang = max(sorted(set(langs)), key=langs.count) if langs else ""
                rows += [(k, lang, *f) for f in own]
            yield pd.DataFrame(rows, columns=["_key", "doc_lang", "n_bytes", "kind", "lang", "ratio", "size", "share", "density", "function", "n_words"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"_key {dict(docs.dtypes)[key]}, doc_lang string, {_FACTS}")


def spam(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spam_share) of all documents that are not blank; those above SPAM_SHARE are spam.

    Null and blank texts are left out; repeated texts are judged alike. The usual compression ratio is
    taken over the prose blocks of all documents, by language and length: a few dozen groups, folded before
    the shuffle. Where a language has no prose, that of all languages is used. No documents: no rows.
    """
    blocks_of = cut(facts(docs, key, text))
    prose = blocks_of.where("kind = 'prose'")
    usual = prose.groupBy("doc_lang", "size").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    overall = prose.groupBy("size").agg(F.avg("ratio").alias("mean_all"), F.stddev_pop("ratio").alias("sd_all"))
    # sizes are logarithms and languages are five, so both tables have at most a few hundred rows
    b = blocks_of.join(F.broadcast(usual.drop("n")), ["doc_lang", "size"], "left").join(F.broadcast(overall), "size", "left")
    mean = F.coalesce("mean", "mean_all", F.lit(-0.4))
    sd = F.greatest(F.coalesce("sd", "sd_all", F.lit(0.1)), F.lit(0.05))
    z = (F.col("ratio") - mean) / sd
    # redundancy flags a block, and its want of sentences and of their words confirms it; links and tags are in both as one sign each
    bad = (F.col("kind") == "other") & (z < REDUNDANT) & (F.col("density") < SENTENCE_DENSITY) & (F.col("function") < FUNCTION_WORDS)
    total = b.groupBy("_key").agg(F.sum(F.when(bad, F.col("n_bytes")).otherwise(0)).alias("bad"), F.sum("n_bytes").alias("n_bytes"))
    return total.select(F.col("_key").alias(key), F.round(F.try_divide("bad", "n_bytes"), 6).alias("spam_share"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam(table(spark, sf, "documents"), "doc_id", "text").where(F.col("spam_share") > SPAM_SHARE).select("doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and spam by source."""
    docs = table(spark, sf, "documents")
    judged = docs.select("doc_id", "source").join(spam(docs, "doc_id", "text"), "doc_id")
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("spam_share") > SPAM_SHARE).alias("n_spam"))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
SQL: dict[str, str] = {}
