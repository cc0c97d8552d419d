"""Text functions as column expressions; the stemmer alone is a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = r"[ \n\t,.:;/\\]"


def split_terms(query: str) -> list[str]:
    """Search terms of a query: lower case, cut at separators, two bytes or more, repeats kept."""
    import re

    return [t for t in re.split(SEPARATORS, query.lower()) if len(t.strip().encode()) >= 2]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: F.octet_length(t) >= 2)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of `term`."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def lexical_score(title: Column, description: Column, content: Column, query: str) -> Column:
    """Occurrences of the query's terms: 3 each in the title, 2 in the description, 1 in the content."""
    score = F.lit(0.0)
    for field, weight in ((title, 3.0), (description, 2.0), (content, 1.0)):
        low = F.lower(F.coalesce(field, F.lit("")))
        for term in split_terms(query):
            score = score + occurrences(low, term) * weight
    return score


def snippet(text: Column, most: int = 240) -> Column:
    """The trimmed text, cut after `most` characters with '...' (never inside a character)."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.left(body, F.lit(most)), F.lit("...")))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


# What is no part of the visible answer.
HIDDEN_BLOCKS = [r"(?s)<[a-z_]+_calls>.*?</[a-z_]+_results>", r"(?s)<thinking>.*?</thinking>", r"(?s)<[^>]+>.*?</[^>]+>"]


def strip_tool_and_thinking(text: Column) -> Column:
    """The answer a user saw: without tool, thinking and tagged blocks; at most one blank line."""
    out = text
    for pattern in HIDDEN_BLOCKS:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


# --- tokens of the full-text index ---


def fold(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case (the unstemmed tokenizer, JVM-side)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(tokens: pd.Series) -> pd.Series:
    """Folded and stemmed forms of token arrays."""
    memo: dict[str, str] = {}

    def one(word: str) -> str:
        if word not in memo:
            memo[word] = stem(fold(word))
        return memo[word]

    return tokens.map(lambda words: [one(w) for w in words])


_VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in _VOWELS:
        return False
    return not (c == "y" and i > 0 and _consonant(word, i - 1))


def _measure(stem_: str) -> int:
    """The number of vowel-consonant sequences."""
    kinds = [_consonant(stem_, i) for i in range(len(stem_))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(stem_: str) -> bool:
    return any(not _consonant(stem_, i) for i in range(len(stem_)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


# The suffix rules of the 1980 paper, steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Porter's stemmer (1980)."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    # Plurals and participles.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, cut = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, cut = word[:-3], True
    if cut:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # Double and single suffixes.
    for rules in (STEP2, STEP3):
        suffix = _longest(word, rules)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + rules[suffix]
    suffix = _longest(word, STEP4)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    # A final e, and double l.
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
