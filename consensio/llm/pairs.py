"""Queries p5_: prompt and response pairs, sound or with one of five defects."""

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from consensio.functions.keys import norm_key
from consensio.llm.endings import STRONG, strip_outer, with_cut
from consensio.llm.truncation import run_texts
from consensio.llm.words import FRAME_WORDS, PLACEHOLDERS, REFUSALS, STOPWORDS
from consensio.operators.durable import fits, hot_keys, salted_join
from consensio.sources.tables import table

#: A copied span has at least so many words in a row.
COPY_WORDS = 4
#: A refusal counts in an answer of so many own words, or where it stands among the first words of a longer one.
REFUSAL_WORDS, REFUSAL_START = 120, 40
#: Share of a response's words that must be copied, and the words beside them that answer nothing.
COPY_SHARE = 0.8

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+(?:['’_][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THINK = re.compile(r"<(/?)(?:think|thinking|reasoning|thought|scratchpad)>", re.I)
_FENCED = re.compile(r"(?:```|~~~)[ \t]*([\w+-]*)[ \t]*\n?(.*?)(?:```|~~~|$)", re.S)
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>")
_QUOTED = re.compile(r"\"[^\"\n]{3,}\"|“[^”\n]{3,}”|«[^»\n]{3,}»|„[^“”\n]{3,}[“”]|「[^」\n]{2,}」")
_CODE_LINE = re.compile(r"^\s*(?:def |class |import |from [\w.]+ import|return\b|for .*:$|while .*:$|if .*:$|else:|elif .*:$|@\w|[\w.\[\]'\"]+(?:, ?\w+)* ?[-+*/]?= ?\S.*$|[\w.]+\(.*\)$|[})]|continue$|break$)")
_CODE = re.compile(r"^\s*(?:def |class |import |from [\w.]+ import|return\b|for .+ in .+:|while .+:|\w+ = )", re.M)
_RESULT = re.compile(r"(?:=+>|[:：=]|\bis\b|\bist\b|\best\b|\bes\b)\s*\**\s*[-+]?[$€£]?\d", re.I)
_SURE = re.compile(r"^[^\n]{0,40}\d{1,3} ?%[^\n]{0,12}$|^\W*confidence\W*\d+\W*$", re.I | re.M)
#: word -> languages that it votes for
_VOTES: dict[str, list[str]] = {}
for _k, _v in STOPWORDS.items():
    for _w in set(_v):
        _VOTES.setdefault(_w, []).append(_k)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in REFUSALS:
        a.add_word(phrase, len(phrase))
    a.make_automaton()
    return a


_REFUSAL = _automaton()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


class SuffixAutomaton:
    """Suffix automaton of a sequence of words."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, last = [-1], [0], 0
        for w in sequence:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def copied(self, sequence: list[str], least: int) -> list[bool]:
        """For each word of sequence, whether it lies in a span of at least `least` words of the automaton's text."""
        out, state, length, done = [False] * len(sequence), 0, 0, 0
        for i, w in enumerate(sequence):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= least:
                for k in range(max(i + 1 - length, done), i + 1):
                    out[k] = True
                done = i + 1
        return out


def without_reasoning(text: str) -> str:
    """text without reasoning blocks, nested ones too; what follows an unclosed one is reasoning, what precedes an unopened end too."""
    if "<" not in text:
        return text
    out, depth, at = [], 0, 0
    for m in _THINK.finditer(text):
        if m[1]:
            if depth:
                depth -= 1
            else:
                out = []
            if not depth:
                at = m.end()
        else:
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
    if not depth:
        out.append(text[at:])
    return "".join(out)


def is_empty(body: str) -> bool:
    """Whether nothing in body, which has no reasoning, answers."""
    core = _TAG.sub(" ", body) if "<" in body else body
    if "```" in core or "~~~" in core:
        core = re.sub(r"(?m)^[ \t]*(?:```|~~~)[ \t]*[\w+-]*[ \t]*$", " ", core)
    core = strip_outer(core)
    if len(core) > 40:
        return False
    core = core.strip(" \t\r\n*_`\"'“”‘’«»[](){}<>|#:：>=").lower()
    return not core or core in PLACEHOLDERS or not re.search(r"\w", core)


def votes(ws: list[str]) -> dict[str, float]:
    """Votes of the words for each language."""
    out = {"en": 0.0, "de": 0.0, "fr": 0.0, "es": 0.0, "zh": 0.0}
    for w in ws:
        if w in _VOTES:
            for k in _VOTES[w]:
                out[k] += 1
        elif len(w) == 1 and _CJK.match(w):
            out["zh"] += 0.4
    return out


#: Prompts whose automata a worker keeps, about 50 KB each; the automaton of another one is built again.
PROMPTS_KEPT = 2048


@lru_cache(maxsize=PROMPTS_KEPT)
def prompt_facts(prompt: str) -> tuple[SuffixAutomaton, frozenset[str], str | None]:
    """Of a prompt: its suffix automaton, its words, and its language if it is clear."""
    ws = words(prompt)
    v = votes(ws)
    best = max(v, key=v.get)
    clear = v[best] >= 2 and v[best] > max(v[k] for k in v if k != best)
    return SuffixAutomaton(ws), frozenset(ws), best if clear else None


def split_code(body: str) -> tuple[str, bool]:
    """body without code, and whether it has any; a fence around something else is only markup."""
    has = False
    if "```" in body or "~~~" in body:

        def fence(m):
            nonlocal has
            if _CODE.search(m[2]):
                has = True
                return "\n"
            return "\n" + m[2] + "\n"

        body = _FENCED.sub(fence, body)
    if "def " in body or "import " in body:
        if any(x.startswith(("def ", "import ", "from ")) for x in body.split("\n")):
            lines = [x for x in body.split("\n") if not _CODE_LINE.match(x)]
            has, body = True, "\n".join(lines)
    return body, has


def defect(prompt: str | None, output: str | None, cut_off: int) -> str | None:
    """The defect of a pair; None if it is sound. An absent prompt counts as an empty one.

    cut_off: 0 not, 1 likely, 2 surely. An answer that only copies is a copy even if it ends early, unless
    it surely was cut off; one that was cut off is truncated whatever else is the matter with it.
    """
    prompt = prompt or ""
    if output is None:
        return "empty"
    body = without_reasoning(output)
    if is_empty(body):
        return "truncated" if cut_off and re.search(r"\w", _TAG.sub("", output)) else "empty"
    if cut_off == 2:
        return "truncated"
    text, code = split_code(body)
    automaton, given, language = prompt_facts(prompt)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "%" in text or "onfidence" in text:
        text = _SURE.sub(" ", text)
    ws = words(text)
    copied = automaton.copied(ws, COPY_WORDS)
    own = [w for w, c in zip(ws, copied) if not c]
    if not code and len(own) < len(ws):
        beside = [w for w in own if w not in FRAME_WORDS]
        span = len(ws) - len(own)
        if span >= COPY_SHARE * (span + len(beside)) and not any(w[0].isdigit() and w not in given for w in beside):
            return "copy"
    if cut_off:
        return "truncated"
    if not code:
        low = text.lower().replace("’", "'").replace("‘", "'")
        at = next((end for end, _ in _REFUSAL.iter(low)), None)
        if at is not None and (len(own) <= REFUSAL_WORDS or len(words(low[:at])) <= REFUSAL_START) and not any(w[0].isdigit() and w not in given for w in own) and not _RESULT.search(text, at):
            return "refusal"
    if language:
        if '"' in text or "“" in text or "«" in text or "「" in text or "„" in text:
            text = _QUOTED.sub(" ", text)
            ws = words(text)
            own = [w for w, c in zip(ws, automaton.copied(ws, COPY_WORDS)) if not c]
        v = votes(own)
        best = max(v, key=v.get)
        if best != language and v[best] >= 3 and v[best] > 1.5 * v[language]:
            return "language"
    return None


@F.pandas_udf(StringType())
def defect_udf(prompt: pd.Series, output: pd.Series, cut_off: pd.Series) -> pd.Series:
    return pd.Series([defect(p, o, c) for p, o, c in zip(prompt, output, cut_off)], dtype=object)


def judged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Run rows whose task exists, with `defect`: null if sound."""
    prompts = table(spark, sf, "tasks").select(norm_key("id").alias("task"), "prompt").dropna(subset=["task"]).dropDuplicates(["task"])
    runs = with_cut(run_texts(spark, sf), F.col("text"))
    surely = F.col("is_cut") & ((F.col("evidence") >= STRONG) | (F.col("p_limit") > 0.9))
    runs = runs.select("row_key", "task", "model", "endpoint", "text", F.when(surely, 2).when(F.col("is_cut"), 1).otherwise(0).alias("cut_off"))
    if fits(prompts):  # their texts, so by bytes too
        pairs = runs.join(F.broadcast(prompts), "task")
    else:
        pairs = salted_join(runs, prompts, ["task"], hot_keys(runs, ["task"]))
    return pairs.withColumn("defect", defect_udf("prompt", "text", "cut_off"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return judged_pairs(spark, sf).where("defect IS NOT NULL").select(F.col("row_key").alias("log_pos"), "defect")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by model and defect; sound pairs are 'sound'."""
    return judged_pairs(spark, sf).groupBy("model", F.coalesce("defect", F.lit("sound")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_pairs"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL: dict[str, str] = {}
