"""Text functions as column expressions; two that Spark lacks as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.functions import likeness

# Chinese numerals with their digits, operator words with their signs.
NUMERALS = {"零": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "十": "10"}
OPERATORS = {"加": "+", "减": "-", "乘": "×", "除以": "÷"}
#: What counts as a blank: White_Space and the four separators of ASCII.
BLANK = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
_NUMBER = rf"(\p{{Nd}}+|[{''.join(NUMERALS)}])"
#: Noncharacters of Unicode, which no text has: they bracket what was captured until it's replaced.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, however often use names it."""
    return F.transform(F.array(c), use)[0]


def _unbracketed(c: Column, words: dict[str, str]) -> Column:
    for word, sign in words.items():
        c = F.replace(c, F.lit(_OPEN + word + _CLOSE), F.lit(sign))
    return F.translate(c, _OPEN + _CLOSE, "")


def spoken_math(c: Column) -> Column:
    """Spoken arithmetic as symbols: 三分之二 -> 2/3, 3 加 五 -> 3+5. Words are rewritten only between two numbers.

    A number is a run of digits or one numeral; 分之 joins them without blanks, an operator also with. One pass from left to right
    each: the last number of an operation isn't the first of another, so 3 加 五 减 1 becomes 3+5 减 1.
    """
    part = lambda k: f"{_OPEN}${k}{_CLOSE}"
    fraction, operation = f"{_NUMBER}分之{_NUMBER}", f"{_NUMBER}{BLANK}*({'|'.join(OPERATORS)}){BLANK}*{_NUMBER}"
    out = F.when(F.contains(c, F.lit("分之")), _unbracketed(F.regexp_replace(c, fraction, f"{part(2)}/{part(1)}"), NUMERALS)).otherwise(c)
    return _once(out, lambda x: F.when(F.rlike(x, F.lit(operation)), _unbracketed(F.regexp_replace(x, operation, part(1) + part(2) + part(3)), NUMERALS | OPERATORS)).otherwise(x))


def plain(c: Column) -> Column:
    """spoken_math, lower case, without any blanks."""
    return F.regexp_replace(F.lower(spoken_math(c)), BLANK, "")


def bigrams(c: Column) -> Column:
    """Distinct neighbouring pairs of characters; one character is its own; '' has none, null gives null."""

    def of(x: Column) -> Column:
        n = F.length(x)
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(x, i, F.lit(2))))
        return F.when(n >= 2, pairs).when(n == 1, F.array(x)).when(n == 0, F.array().cast("array<string>"))

    return _once(c, of)


def summary(c: Column, most: int = 60) -> Column:
    """The first `most` characters, with an ellipsis only if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


@F.pandas_udf(T.StringType())
def folded_name(s: pd.Series) -> pd.Series:
    """NFKC, lower case, without blanks, punctuation and underscores."""
    return s.map(lambda x: None if x is None else re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", x).lower()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def occurrences(s: pd.Series) -> pd.Series:
    """The characters of a name, each followed by its number among equal ones."""
    return s.map(likeness.occurrences)


def paragraphs(text: Column) -> Column:
    """Text cut at blank lines, with all line ends read as one kind; blank pieces are left out, the rest trimmed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(F.split(t, r"\n[ \t　]*(?:\n[ \t　]*)+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: F.length(p) > 0)


CODED = r"(?sU)^(\d+(?:\.\d+)+)[ 　]+(.+)$"


def code_of(paragraph: Column) -> Column:
    """The number of two or more levels that starts a paragraph and is followed by a blank and text; else ''."""
    return F.regexp_extract(paragraph, CODED, 1)


def body_of(paragraph: Column) -> Column:
    return F.regexp_extract(paragraph, CODED, 2)


def topic_id(name: Column, domain: Column, grade_start: Column) -> Column:
    """A stable id from a topic's name, domain and first grade."""
    return F.concat(F.lit("t_"), F.substring(F.sha1(F.concat_ws("|", name, domain, grade_start.cast("string"))), 1, 10))


def padded(prefix: Column, joint: str, number: Column, width: int) -> Column:
    """prefix, joint and the number with leading zeros to the width; longer numbers stay whole."""
    return F.concat(prefix, F.lit(joint), F.format_string(f"%0{width}d", number))
