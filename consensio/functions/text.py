"""Text functions as column builders; what regular expressions cannot say is a pandas UDF."""

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Categories of abstention, in order, with their patterns. Fixed values.
ABSTENTION = [
    ("EXPLICIT_ABSTENTION", [
        r"\bi\s+(?:must\s+)?(?:abstain|refuse|decline)\b",
        r"\bcannot\s+(?:and\s+will\s+not|provide|give)\b",
        r"\bI\s+(?:am\s+not\s+able|am\s+unable)\s+to\s+(?:answer|respond|provide)\b",
        r"\bI\s+won['']t\s+(?:answer|respond|provide)\b",
    ]),
    ("CANNOT_DETERMINE", [
        r"\b(?:cannot|can['']t|impossible\s+to|not\s+possible\s+to)\s+(?:determine|know|tell|say|decide|conclude|ascertain|identify)\b",
        r"\b(?:there\s+is\s+)?(?:no\s+way\s+(?:to\s+)?(?:know|tell|determine))\b",
        r"\b(?:it\s+is\s+)?(?:unknowable|indeterminate|undecidable)\b",
        r"\bcannot\s+be\s+(?:determined|known|inferred|concluded)\b",
        r"\b(?:do\s+not|don['']t)\s+know\s+which\b",
    ]),
    ("NEED_MORE_INFO", [
        r"\b(?:need|require|lack|missing|without|have\s+no)\b.{0,40}(?:more\s+)?(?:information|context|detail|data|clarification|specification)\b",
        r"\b(?:insufficient|inadequate|incomplete)\s+(?:information|context|data|detail)\b",
        r"\bmore\s+(?:context|information|detail|data)\s+(?:is\s+)?(?:needed|required|necessary)\b",
        r"\bwithout\s+(?:more|additional|further)\s+(?:context|information|detail|clarification)\b",
        r"\bI\s+don['']t\s+have\s+(?:enough|sufficient)\s+(?:context|information|detail)\b",
        r"\bplease\s+provide\s+(?:more|additional|further)\s+(?:context|information|detail|clarification)\b",
        r"\bprovide\s+(?:more|additional|further)\s+(?:context|information)\s+before\b",
    ]),
    ("WHICH_MEAN", [
        r"\bwhich\b.{0,60}(?:did\s+you\s+mean|do\s+you\s+mean|are\s+you\s+referring)\b",
        r"\bwhat\s+(?:do\s+you\s+mean|did\s+you\s+mean)\s+by\b",
        r"\bcould\s+you\s+(?:please\s+)?clarify\s+(?:which|what|whether)\b",
        r"\bplease\s+(?:clarify|specify|indicate)\s+(?:which|what|whether)\b",
        r"\bare\s+you\s+(?:referring|asking)\s+(?:to|about)\b.{0,40}\?",
        r"\bwhich\s+interpretation\s+is\s+intended\b",
    ]),
    ("CLARIFICATION_QUESTION", [
        r"(?:which|what|could\s+you|can\s+you|would\s+you|do\s+you\s+mean)[^.!?]{0,120}\?\s*$",
        r"(?:clarify|specify|elaborate|disambiguate|explain\s+what\s+you\s+mean)[^.!?]{0,80}\?\s*$",
        r"(?:are\s+you\s+asking|are\s+you\s+referring|do\s+you\s+want)[^.!?]{0,120}\?\s*$",
    ]),
    ("AMBIGUITY_FLAG", [
        r"\b(?:the\s+)?(?:question|prompt|task|request|statement)\s+is\s+(?:ambiguous|unclear|vague|underspecified|ambiguous)\b",
        r"\bthis\s+(?:is|seems?|appears?)\s+(?:ambiguous|unclear|vague|underspecified)\b",
        r"\bthe\s+(?:intent|meaning|referent)\s+(?:is|remains?)\s+(?:unclear|ambiguous)\b",
        r"\bmultiple\s+(?:valid\s+)?interpretations?\s+(?:are\s+)?possible\b",
        r"\bit['']s\s+(?:not\s+)?(?:clear|obvious)\s+(?:which|what|whether)\b",
    ]),
    ("ASSUMING", [
        r"\b(?:assuming|i['']ll\s+assume|i['']m\s+assuming|let\s+me\s+assume)\b.{0,80}(?:you\s+mean|you['']re\s+asking|this\s+refers\s+to)\b",
        r"\bassuming\s+(?:that\s+)?(?:by|you\s+mean|this\s+is\s+about)\b",
        r"\bi\s+(?:will|shall|am\s+going\s+to)\s+assume\b.{0,80}(?:you\s+(?:mean|are\s+asking|are\s+referring)|the\s+question\s+(?:refers|is\s+about))\b",
        r"\bin\s+the\s+absence\s+of\s+(?:more|additional|further)\s+(?:context|information)\b",
        r"\bassuming\b.{0,60}\binterpretation\s+is\s+intended\b",
        r"\bassuming\s+(?:the\s+)?(?:first|second|third|fourth|1st|2nd|3rd|4th)\s+interpretation\b",
    ]),
]
#: The two patterns that do not count where the text resolves the question, and what resolves it. Fixed values.
GUARDED = [r"\bwhich\s+interpretation\s+is\s+intended\b", r"\b(?:do\s+not|don['']t)\s+know\s+which\b"]
RESOLVED = r"\b(?:clearly\s+states?|unambiguously\s+(?:requires?|states?|demands?|indicates?))\b|\bthe\s+answer\s+is\s+I\w+|\bso\s+the\s+answer\s+is\b"
COMMIT = "CONFIDENT_COMMIT"
#: Of each category, words one of which every match of its patterns holds; a text without them is not searched.
NEEDED = {
    "EXPLICIT_ABSTENTION": ["abstain", "refuse", "decline", "cannot", "able", "won"],
    "CANNOT_DETERMINE": ["determine", "know", "tell", "say", "decide", "conclude", "ascertain", "identify", "unknowable", "indeterminate", "undecidable", "inferred"],
    "NEED_MORE_INFO": ["information", "context", "detail", "data", "clarification", "specification"],
    "WHICH_MEAN": ["mean", "referring", "clarify", "specify", "indicate", "asking", "interpretation"],
    "CLARIFICATION_QUESTION": ["?"],
    "AMBIGUITY_FLAG": ["ambiguous", "unclear", "vague", "underspecified", "interpretation", "clear", "obvious"],
    "ASSUMING": ["assum", "absence"],
}
#: Words that say nothing about an axis. Fixed values.
AXIS_STOPWORDS = "a an the of to for in on at by is are be do does which what when where how that this these those or and it its with as your you answer value single should would could may might rounded decimal places returns return function given between from into per each".split()
# What makes a dimension one of format or tooling: words, phrases of its name, and languages. Fixed values.
FORMAT_WORDS = "language languages programming python javascript typescript java kotlin ruby php golang rust cpp csharp scala perl swift syntax library libraries framework frameworks module modules import imports package packages dependency dependencies tooling toolchain runtime interpreter compiler ide encoding charset unicode utf ascii whitespace indentation codestyle".split()
LANGUAGE_WORDS = "python javascript typescript java kotlin ruby php golang go rust cpp c csharp scala perl swift r matlab sql bash".split()
FORMAT_PHRASES = ["programming language", "output format", "output encoding", "file type", "file format", "code style", "coding style", "display format", "string formatting", "which language", "output scope", "return type wrapper"]
_FLAGS = "(?iuUd)"


def _may(text: Column, name: str) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in NEEDED[name]:
        out = out | low.contains(w)
    return out


def abstention_signal(text: Column) -> Column:
    """Name of the first category with a pattern that is found; CONFIDENT_COMMIT for none and for null and empty texts."""
    resolved = text.rlike(_FLAGS + RESOLVED)
    out = F.when(text.isNull() | (text == ""), COMMIT)
    for name, patterns in ABSTENTION:
        free = "|".join(f"(?:{p})" for p in patterns if p not in GUARDED)
        hit = text.rlike(_FLAGS + free)
        for p in patterns:
            if p in GUARDED:
                hit = hit | (text.rlike(_FLAGS + p) & ~resolved)
        out = out.when(_may(text, name) & hit, name)
    return out.otherwise(COMMIT)


def abstention_evidence(text: Column) -> Column:
    """The text that the first pattern that counts has found, trimmed; '' for none."""
    resolved = text.rlike(_FLAGS + RESOLVED)
    out = F.when(text.isNull() | (text == ""), "")
    for _, patterns in ABSTENTION:
        for p in patterns:
            hit = text.rlike(_FLAGS + p)
            out = out.when(hit & ~resolved if p in GUARDED else hit, F.trim(F.regexp_extract(text, f"{_FLAGS}({p})", 1)))
    return out.otherwise("")


#: Names and ids of interpretations with what stands in for them, phrases before bare ids; and what betrays a label. Fixed values.
MASKS = [(r"(?i)\bInterpretation\s+I\d+(?:\s*\([^)\n]{0,80}\))?", "[interpretation]"), (r"\bI_perp\b", "[interpretation]"), (r"\bI[0-7]\b", "[option]")]
BETRAYS = r"\bI[0-7]\b|\bI_perp\b|\bInterpretation\s+I\d"


def mask_labels(text: Column) -> Column:
    """Names and ids of interpretations replaced."""
    for pattern, instead in MASKS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def leaks_label(text: Column) -> Column:
    return text.rlike(BETRAYS)


def keywords(text: Column) -> Column:
    """Distinct words of three or more letters or digits that are no stopwords."""
    w = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(AXIS_STOPWORDS)))


def axis_match(dimension: Column, questions: Column) -> Column:
    """Whether some question shares two keywords with the dimension, or the only one it has."""
    d = keywords(dimension)
    ok = F.exists(questions, lambda q: (F.size(keywords(q)) > 0) & (F.size(F.array_intersect(d, keywords(q))) >= F.when(F.size(keywords(q)) <= 1, 1).otherwise(2)))
    return F.coalesce((F.size(d) > 0) & ok, F.lit(False))


def is_format_dimension(name: Column, values: Column | None = None) -> Column:
    """Whether a dimension is about format or tooling: by its name, or because each of its values names a language."""

    def holds(text: Column, of: list[str]) -> Column:
        return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array(*[F.lit(x) for x in of]))

    hit = F.coalesce(holds(name, FORMAT_WORDS), F.lit(False))
    for p in FORMAT_PHRASES:
        hit = hit | F.coalesce(F.lower(name).contains(p), F.lit(False))
    if values is not None:
        hit = hit | ((F.coalesce(F.size(values), F.lit(0)) > 0) & F.coalesce(F.forall(values, lambda v: F.coalesce(holds(v, LANGUAGE_WORDS), F.lit(False))), F.lit(False)))
    return hit


def clean_dimensions(dims: Column, most: int = 8) -> Column:
    """The first `most` dimensions (dimension, values) that have a name and two distinct values; all trimmed, blank values left out."""

    def trimmed(t: Column) -> Column:
        return F.regexp_replace(t, r"^\s+|\s+$", "")

    def clean(d: Column) -> Column:
        values = F.array_distinct(F.filter(F.transform(d["values"], trimmed), lambda v: v.isNotNull() & (v != "")))
        return F.struct(trimmed(d["dimension"]).alias("dimension"), values.alias("values"))

    own = F.filter(F.transform(dims, clean), lambda d: F.coalesce((d["dimension"] != "") & (F.size(d["values"]) >= 2), F.lit(False)))
    return F.slice(own, 1, most)


def token_confidence(logprobs: Column, first: int = 5) -> Column:
    """exp of the mean of the first few log probabilities of tokens; NULL without any. Nulls are left out, but count among the first."""
    own = F.filter(F.slice(logprobs, 1, first), lambda x: x.isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(own) > 0, F.exp(total / F.nullif(F.size(own), F.lit(0))))


def same_value(got: Column, want: Column, kind: str, tolerance: float = 1e-9) -> Column:
    """Whether two values of a kind (of DataFrame.dtypes) are equal: doubles within the tolerance, everything else exactly; null only equals null."""
    if kind not in ("double", "float"):
        return got.eqNullSafe(want)
    near = F.abs(got - want) < tolerance
    return F.when(got.isNull() | want.isNull(), got.isNull() & want.isNull()).otherwise((got == want) | near)


def same_answer(got: Column, want: Column, fields: dict[str, str]) -> Column:
    """Whether two structs agree in all fields (name -> kind): texts without case and outer white space, doubles to the cent, the rest exactly."""
    out = got.isNotNull() & want.isNotNull()
    for name, kind in fields.items():
        x, y = got[name], want[name]
        if kind == "string":
            x, y = F.lower(F.trim(x)), F.lower(F.trim(y))
        elif kind in ("double", "float"):
            x, y = F.bround(x * 100, 0), F.bround(y * 100, 0)
        out = out & x.eqNullSafe(y)
    return out


def final_amounts(text: Column) -> Column:
    """Amounts of FINAL ANSWER lines in cents, signed; what is not a well-formed amount is NULL in the array."""
    tail = F.regexp_extract_all(text, F.lit(r"(?i)\bFINAL\s+ANSWER\s*[:=]\s*([^\n]*)"), 1)
    plain = r"^\(?\s*[-+]?\s*\$?\s*[-+]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*\)?[.\s*]*$"

    def one(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "")
        sign = F.when((F.length(F.regexp_replace(t, "[^-]", "")) + F.when(t.startswith("("), 1).otherwise(0)) % 2 == 1, -1).otherwise(1)
        return F.when(t.rlike(plain), (F.round(digits.cast("decimal(30,6)") * 100, 0) * sign).cast("bigint"))

    return F.transform(tail, one)


def agreed_amount(amounts: Column) -> Column:
    """The amount all agree on; NULL if there is none, one is invalid or two differ."""
    return F.when((F.size(amounts) > 0) & ~F.exists(amounts, lambda x: x.isNull()) & (F.size(F.array_distinct(amounts)) == 1), F.get(amounts, F.lit(0)))


def amount_signature(value: Column) -> Column:
    """num:<cents>, half to even."""
    return F.concat(F.lit("num:"), F.bround(value * 100, 0).cast("bigint").cast("string"))


def sha_index(text: Column, m: int) -> Column:
    """SHA-256 of text modulo m, over all its bits."""
    d = F.transform(F.split(F.sha2(text, 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(d, lambda x: x >= 0), F.lit(0), lambda acc, x: F.pmod(acc * 16 + x, F.lit(m)).cast("int"))


_TAG = re.compile(r"<(/?)(think|thinking|reasoning|thought)>", re.I)


def strip_reasoning_text(text: str) -> str:
    """text without reasoning; an unclosed block drops the rest, a close without an opening what precedes it."""
    out, depth, at = [], 0, 0
    for m in _TAG.finditer(text):
        if not m[1]:
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
        else:
            out, at = [], m.end()
    if not depth:
        out.append(text[at:])
    return "".join(out).strip()


@F.pandas_udf(StringType())
def strip_reasoning(text: pd.Series) -> pd.Series:
    return text.map(strip_reasoning_text, na_action="ignore")


def python_blocks_of(text: str) -> list[str]:
    """Python blocks of text: fenced ones without a language or of Python; the text itself if it is code and has no fence."""
    found = [m[2] for m in re.finditer(r"```[ \t]*([\w+-]*)[ \t]*\n(.*?)```", text, re.S) if m[1].lower() in ("", "python", "py", "python3")]
    if found or "```" in text:
        return [x.strip() for x in found if x.strip()]
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [text.strip()] if text.strip() else []


@F.pandas_udf(ArrayType(StringType()))
def python_blocks(text: pd.Series) -> pd.Series:
    return text.map(python_blocks_of, na_action="ignore")


def first_json_array_of(text: str) -> str | None:
    """The first JSON array in text, as JSON."""
    decoder = json.JSONDecoder()
    at = text.find("[")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, list):
                return json.dumps(value)
        except (ValueError, RecursionError):
            pass
        at = text.find("[", at + 1)
    return None


@F.pandas_udf(StringType())
def first_json_array(text: pd.Series) -> pd.Series:
    return text.map(first_json_array_of, na_action="ignore")


def json_amounts_of(text: str) -> list[float | None]:
    """Values of `amount` in all JSON objects of text, in order; None for one that is no finite number."""
    decoder, out, at = json.JSONDecoder(), [], text.find("{")

    def walk(v):
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "amount":
                    ok = isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")
                    out.append(float(x) if ok else None)
                else:
                    walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            walk(value)
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return out


def row_id(*parts: Column) -> Column:
    """The first 16 digits of SHA-1 over the parts; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws(chr(31), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)
