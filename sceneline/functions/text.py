"""Text functions: native columns where Spark has the means, Arrow UDFs where it has none."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, with one optional inner apostrophe; the same in Java's and RE2's syntax.
TOKEN = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
_PY_TOKEN = re.compile(r"\w+(?:'\w+)?")
#: Phrases of two or more tokens that say nothing about their place.
GENERIC = ("all right", "come on", "thank you", "excuse me", "i know", "of course")


def tokens(text: Column) -> Column:
    """Lower-case words, curly apostrophes made straight."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[‘’]", "'")), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def folded_tokens(text: pd.Series) -> pd.Series:
    """Case-folded NFKC words with their offsets in the NFKC text (Spark has no Unicode normalisation)."""

    def one(t):
        if t is None:
            return None
        n = unicodedata.normalize("NFKC", t).replace("‘", "'").replace("’", "'")
        return [{"token": m[0].casefold(), "start": m.start(), "end": m.end()} for m in _PY_TOKEN.finditer(n)]

    return text.map(one)


def informative(toks: Column) -> Column:
    """At least four words, or at least two that are 15 characters long together and no set phrase."""
    joined = F.array_join(toks, " ")
    return (F.size(toks) >= 4) | ((F.size(toks) >= 2) & (F.length(joined) >= 15) & ~joined.isin(*GENERIC))


def clean(text: Column) -> Column:
    """Without tags and notes, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "[♪♫]", ""), r"[\s ]+", " "))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references decoded, NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def language(text: Column) -> Column:
    """zh if there are at least as many CJK as Latin letters, en if there are Latin letters, else und."""
    cjk = F.regexp_count(text, F.lit("[一-鿿]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (cjk >= latin), "zh").when(latin > 0, "en").otherwise("und")


def upper_share(text: Column) -> Column:
    """Share of capitals among the ASCII letters, 0 without letters."""
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("[A-Z]")) / letters).otherwise(F.lit(0.0))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm; hours are not wrapped."""
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000).cast("long"))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS,mmm, HH:MM:SS.mmm or MM:SS.mmm."""
    p = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    n = F.size(p)
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).cast("double"), F.lit(0.0))
    return F.when(n >= 3, part(1) * 3600 + part(2) * 60 + part(3)).otherwise(part(1) * 60 + part(2))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word per step for each character of ``b``."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); equal to 1 for two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    one, two = " ".join(left), " ".join(right)
    if not both:
        return ratio(one, two)
    n = sum(map(len, both)) + len(both)  # what comes first in both strings, with a blank after it
    a, b = n + len(one), n + len(two)
    return max(2 * (n + lcs(one, two)) / (a + b), 2 * (n - 1) / (n - 1 + a), 2 * (n - 1) / (n - 1 + b))


def fuzzy(a: list[str], b: list[str]) -> float:
    """The plain ratio of the joined words, or the token-set ratio times the coverage, whichever is more."""
    if not a or not b:
        return 0.0
    return max(ratio(" ".join(a), " ".join(b)), token_set_ratio(a, b) * min(len(a), len(b)) / max(len(a), len(b)))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with windows of its length of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def _pairs(f):
    return lambda a, b: pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: fuzzy(list(x), list(y)))(a, b)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(ratio)(a, b)


@F.pandas_udf(T.DoubleType())
def partial_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(partial_ratio)(a, b)
