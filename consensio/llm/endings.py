"""How a text ends: evidence that it was cut off, from its ending and from the lengths of its source."""

import ast
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from consensio.operators.durable import cut, fits, hot_keys, salted_join

#: Log-odds that an ending lends to the text being cut off.
STRONG, CUT, OPEN, LIKELY_WHOLE, WHOLE = 9.0, 6.0, 1.0, -1.5, -7.0
#: Share of texts taken as cut where lengths say nothing.
BASE_RATE = 0.01

_OUTER = re.compile("^[\\s​⁠﻿]+|[\\s​⁠﻿]+$")
_FENCE = re.compile(r"^[ \t>]*(?:```|~~~)", re.M)
_THINK = re.compile(r"<(/?)(think|thinking|reasoning|thought|scratchpad)>", re.I)
#: Marks that transports and editors put at a break.
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|�+|[\[(<](?:\W*)(?:truncated|cut off|cut|continued|continues|output truncated|max(?:imum)? (?:length|tokens)[^\])>]*|length limit[^\])>]*|incomplete|snip|gekürzt|abgeschnitten|tronqué|coupé|cortado|truncado|截断|未完|\+? ?[\d,]+ (?:more )?(?:chars|characters|bytes|tokens|words|lines)(?: (?:more|omitted|truncated))?|…|\.\.\.)(?:\W*)[\])>]))+$", re.I)
_CLOSERS = "*_`\"'”’»)]}>）」』】》"
_FINAL = ".!?。！？…؟।"
_NUMBER = r"[-+(]?[$€£¥]?\d[\d.,' ]*(?:%|[$€£¥])?\)?"
_CODE_LINE = re.compile(r"^(?:def |class |import |from \w+ import |@\w|async def |for \w+ in |while |if .*:$|return\b|[A-Za-z_]\w*(?:\[.*\]|\.\w+)* ?(?:[-+*/]?=) ?\S)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LIST_MARK = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s*$")
_BARE = re.compile(rf"^\W*(?:{_NUMBER}|[\w.+-]+)\W*$")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def strip_outer(text: str) -> str:
    """text without outer white space and zero-width characters."""
    return _OUTER.sub("", text)


def open_reasoning(text: str) -> bool:
    """Whether a reasoning tag is open at the end."""
    depth = 0
    for m in _THINK.finditer(text):
        depth = max(0, depth - 1) if m[1] else depth + 1
    return depth > 0


def _delimiters(code: str) -> bool:
    """Whether a bracket or a string is open at the end of a line of code."""
    stack, quote, k = [], "", 0
    while k < len(code):
        c = code[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote or c == "\n":
                quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            k = code.find("\n", k)
            if k < 0:
                break
        elif c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
        k += 1
    return bool(stack or quote)


def _code(code: str) -> float:
    """Evidence from bare code."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return CUT if _delimiters(code) or not code.rstrip().endswith((";", "}", "end")) else OPEN
    last = tree.body[-1] if tree.body else None
    if isinstance(last, (ast.FunctionDef, ast.AsyncFunctionDef)):
        own = [n for n in ast.walk(last) if isinstance(n, (ast.Return, ast.Yield))]
        end = last.body[-1]
        if isinstance(end, ast.Return):
            return LIKELY_WHOLE if isinstance(end.value, (ast.Name, ast.Attribute, ast.Constant)) else WHOLE if end.value else CUT
        if isinstance(end, (ast.Assign, ast.AugAssign)):
            return CUT if not own else OPEN
        return OPEN if not own else LIKELY_WHOLE
    if isinstance(last, (ast.Import, ast.ImportFrom)):
        return CUT
    return LIKELY_WHOLE


def _last_line(body: str, usual: float | None) -> float:
    """Evidence from the last line of a text; usual: see last_lines."""
    found = _prose(body)
    if usual is None:
        return found
    if usual < -1 and not _LIST_MARK.match(body[body.rfind("\n") + 1 :]):
        return max(WHOLE, min(found, usual))
    return found + usual if usual > 2 and found <= OPEN else found


def _prose(body: str) -> float:
    """Evidence from the last line of prose."""
    line = body[body.rfind("\n") + 1 :].strip()
    if _LIST_MARK.match(line):
        return CUT
    if line.count("**") % 2:
        return CUT  # bold type that does not end
    words = line.split()
    core = line.rstrip(_CLOSERS)
    last = core[-1:] or line[-1]
    if last in _FINAL:
        # a number cut at its decimal point looks like the end of a sentence
        if last == "." and len(words) > 4 and core[-2:-1].isdigit():
            return 2 * LIKELY_WHOLE
        return WHOLE
    if last in ",;，；、(（[{-–—:：":
        if len(words) == 1 and "\n" not in body and last not in ",;，；、":
            return LIKELY_WHOLE
        return OPEN if last in ":：" and len(words) <= 2 else CUT
    if _CJK.search(line[-3:]):
        return CUT if len(line) > 4 else OPEN
    if "\n" not in body and (len(words) <= 2 or _BARE.match(line)):
        return LIKELY_WHOLE - 2 if len(words) <= 2 else LIKELY_WHOLE
    if len(words) == 1 and body[: -len(line)].endswith("\n\n") and _BARE.match(line) and any(c.isdigit() for c in line):
        return LIKELY_WHOLE  # a value in a paragraph of its own
    if len(words) == 1 and line[-1] in _CLOSERS and line[0] in "*_`\"'([{<":
        return WHOLE
    if line[-1] in ")]}\"'" and re.match(r"^[\[({\"']", line):
        return WHOLE if not _delimiters(line) else CUT
    if re.match(r"^(?:https?://|www\.)\S+$", line) or re.match(r"^#{1,6} ", line) or line.startswith("|"):
        return LIKELY_WHOLE
    if "\n" not in body and len(words) <= 8 and line[:1].islower():
        return LIKELY_WHOLE  # short and informal
    return CUT


def ending_evidence(text: str | None, usual: float | None = None) -> float | None:
    """Log-odds from the ending that the text breaks off; None for an absent or blank text.

    The whole text is read: an open code fence or reasoning tag anywhere counts. usual: how much more often texts cut anywhere
    end in the form of its last line than texts do (see last_lines); None where that is not known.
    """
    if text is None:
        return None
    s = strip_outer(text)
    if not s:
        return None
    marked = _MARK.search(s, max(0, len(s) - 80)) if s[-1] in "….�])>" else None  # marks are at the very end
    if marked:
        before = strip_outer(s[: marked.start()])
        if not before:
            return LIKELY_WHOLE
        if "�" in marked[0]:
            return STRONG
        e = ending_evidence(before)
        return STRONG if e is not None and (e > 0 or before[-1] not in _FINAL) else OPEN
    if "<" in s and open_reasoning(s):
        return STRONG
    fences = len(_FENCE.findall(s)) if ("```" in s or "~~~" in s) else 0
    if fences % 2:
        return STRONG
    if fences and s.endswith(("```", "~~~")):
        start = s.rfind("```", 0, len(s) - 3)
        block = s[start + 3 : -3] if start >= 0 else ""
        return CUT if _delimiters(block) and re.match(r"(?:py\w*)?\n\s*(?:def|import|from|class)\b", block) else WHOLE
    if s.endswith(">") and (m := list(_THINK.finditer(s))) and m[-1].end() == len(s):
        return WHOLE
    rest = s[s.rfind("</think>") + 8 :].strip() if "</think>" in s else s
    if not fences and _CODE_LINE.match(rest) and ("\n" in rest or rest.startswith(("def ", "import ", "from "))):
        return _code(rest)
    if not fences and rest.startswith(("{", "[")):
        return CUT if _delimiters(rest) else WHOLE
    return _last_line(rest or s, usual)


@F.pandas_udf(DoubleType())
def ending_evidence_udf(text: pd.Series, usual: pd.Series) -> pd.Series:
    known = usual.where(usual.notna(), None) if usual.notna().any() else [None] * len(text)
    return pd.Series([ending_evidence(t, None if u is None or u != u else u) for t, u in zip(text, known)], dtype="float64")


#: Last lines of at most so many characters have a form; one is known that at least FORM_COUNT texts and one in FORM_SHARE end in, so
#: there are fewer than FORM_SHARE forms.
FORM_CHARS, FORM_COUNT, FORM_SHARE = 48, 20, 10_000


def form_of(text: Column) -> Column:
    """Hash of the form of a text's last line: in lower case, a whole number is 0, every digit after a point or comma 0; NULL if the line is longer than FORM_CHARS or blank."""
    # what ends in a longer line needs no more of the text than shows that
    tail = F.right(F.rtrim(text, F.lit(" \t\r\n\f\v\u00a0\u200b\u2060\ufeff")), F.lit(FORM_CHARS + 1))
    line = F.trim(F.substring_index(tail, "\n", -1))
    return F.when((line != "") & (F.length(line) <= FORM_CHARS), F.xxhash64(F.translate(F.regexp_replace(F.lower(line), r"(?<![.,\d])\d+", "0"), "123456789", "000000000")))


def last_lines(texts: DataFrame, text: Column, key: str) -> DataFrame:
    """form, usual: for each common form of last lines, the log of how much more often it ends a text that is cut than a text as it is.

    Every text is cut once, at a place drawn by its key, so both shares are of all texts. 'confidence: 0%' ends many texts and few
    cut ones, 'confiden' the other way round, in whatever language. Only hashes and counts are shuffled.
    """
    cut_at = F.pmod(F.xxhash64(F.lit("cut"), F.col(key)), F.greatest(F.lit(1), F.length(text))) + 1
    both = F.array(F.struct(F.lit(0).alias("cut"), form_of(text).alias("form")), F.struct(F.lit(1).alias("cut"), form_of(F.substring(text, F.lit(1), cut_at.cast("int"))).alias("form")))
    rows = texts.where(text.isNotNull()).select(F.explode(both).alias("e")).select("e.*")
    n = rows.groupBy("form").agg(F.count_if(F.col("cut") == 0).alias("whole"), F.count_if(F.col("cut") == 1).alias("cuts"))
    n = cut(n)  # for the total and for the forms
    total = n.agg(F.sum("whole").alias("n")).withColumn("least", F.greatest(F.lit(FORM_COUNT), F.col("n") / FORM_SHARE))
    # one row; texts without a form are in the total
    known = n.where("form IS NOT NULL").join(F.broadcast(total)).where(F.col("whole") + F.col("cuts") >= F.col("least"))
    return known.select("form", F.log((F.col("cuts") + 0.5) / (F.col("whole") + 0.5)).alias("usual"))


def _phi(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _tail(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def fit_censored(x: np.ndarray, n: np.ndarray, limit: float) -> tuple[float, float]:
    """Maximum likelihood of a log-normal from counts n of lengths x, those at or beyond limit right-censored.

    The expectation-maximisation steps use the moments of the normal beyond the limit.
    """
    y, w = np.log(np.maximum(x, 0.5)), n.astype(float)
    free = x < limit
    c, a, k = w[~free].sum(), math.log(max(limit, 0.5)), w[free].sum()
    if k < 2:
        return a, 1.0
    s1, s2 = (w * y)[free].sum(), (w * y * y)[free].sum()
    mu, sd = s1 / k, max(math.sqrt(max(s2 / k - (s1 / k) ** 2, 0)), 0.05)
    for _ in range(200):
        z = (a - mu) / sd
        hazard = _phi(z) / _tail(z) if z < 30 else z
        m1 = mu + sd * hazard
        m2 = mu * mu + sd * sd + sd * (a + mu) * hazard
        t1, t2 = (s1 + c * m1) / (k + c), (s2 + c * m2) / (k + c)
        sd2 = max(math.sqrt(max(t2 - t1 * t1, 0)), 0.05)
        done = abs(t1 - mu) + abs(sd2 - sd) < 1e-7
        mu, sd = t1, sd2
        if done:
            break
    return mu, sd


#: A candidate limit holds at least so many texts, and at most this share of its source is longer.
LIMIT_COUNT, LONGER_SHARE = 5, 0.02


def censoring(x: np.ndarray, n: np.ndarray) -> list[tuple[int, float]]:
    """Candidate limits of a source with the posterior that a text of just that length was cut there."""
    order = np.argsort(x)
    x, n = x[order], n[order]
    total = n.sum()
    longer = total - np.cumsum(n)
    out = []
    for i in np.flatnonzero((n >= LIMIT_COUNT) & (longer <= LONGER_SHARE * total) & (x > 1)):
        limit = float(x[i])
        mu, sd = fit_censored(x, n, limit)
        z = (math.log(limit) - mu) / sd
        # what the length would hold without a limit: by the fit, and by its neighbours
        near = n[(x >= limit * 0.9) & (x < limit)]
        expected = max(total * _phi(z) / (sd * limit), near.sum() / max(1.0, limit - math.ceil(limit * 0.9)), 0.5)
        p = 1 - expected / n[i]
        if n[i] >= 3 * expected:
            out.append((int(limit), float(min(p, 0.995))))
    return out


_SOURCES = [("endpoint", "chars"), ("endpoint", "bytes"), ("model", "tokens"), ("endpoint", "tokens"), ("model", "chars")]


def limits(texts: DataFrame) -> DataFrame:
    """Length limits of sources: dim, source, measure, value, p.

    texts: origin, endpoint, model, chars, bytes, tokens. Only counts by length leave the executors' first
    stage, so a source that holds a third of all rows is a histogram like any other.
    """
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.concat_ws("\t", "origin", d).alias("source"), F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for d, m in _SOURCES])
    counts = texts.select(F.explode(each).alias("e")).select("e.*").where("value > 0").groupBy("dim", "source", "measure", "value").agg(F.count(F.lit(1)).alias("n"))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = censoring(pdf["value"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([(*key, v, p) for v, p in found], columns=["dim", "source", "measure", "value", "p"])

    return counts.groupBy("dim", "source", "measure").applyInPandas(fit, "dim string, source string, measure string, value bigint, p double")


def with_cut(texts: DataFrame, text: Column, key: str = "row_key") -> DataFrame:
    """texts (see limits) with `evidence`, `p_limit` and `is_cut`; evidence is null and is_cut false for blank texts."""
    found = cut(limits(texts))
    small = fits(found, 100_000)
    forms = cut(last_lines(texts, text, key))  # fewer than FORM_SHARE, see there
    out = texts.withColumn("_form", form_of(text)).join(F.broadcast(forms.withColumnRenamed("form", "_form")), "_form", "left").withColumn("evidence", ending_evidence_udf(text, F.col("usual"))).drop("_form", "usual")
    names = []
    for i, (d, m) in enumerate(_SOURCES):
        part = found.where((F.col("dim") == d) & (F.col("measure") == m)).select(F.col("source").alias("_s"), F.col("value").alias("_v"), F.col("p").alias(f"_p{i}"))
        out = out.withColumns({"_s": F.concat_ws("\t", "origin", d), "_v": F.col(m).cast("bigint")})
        if small:
            out = out.join(F.broadcast(part), ["_s", "_v"], "left").drop("_s", "_v")
        else:
            out = salted_join(out, part, ["_s", "_v"], hot_keys(out.select("_s", "_v"), ["_s", "_v"]), "left").drop("_s", "_v")
        names.append(f"_p{i}")
    out = out.withColumn("p_limit", F.greatest(*[F.coalesce(F.col(k), F.lit(BASE_RATE)) for k in names])).drop(*names)
    return out.withColumn("is_cut", F.coalesce(F.log(F.col("p_limit") / (1 - F.col("p_limit"))) + F.col("evidence") > 0, F.lit(False)))
