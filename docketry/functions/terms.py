"""Index terms: English stems without stop words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP = frozenset("a an and are as at be but by for from had has have if in into is it its no not of on or such that the their then there these they this to was were will with".split())
_WORD = re.compile(r"[a-z][a-z0-9]*|[0-9]+|[一-鿿]")
_V = "aeiou"


def _measure(w: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    shape = "".join("v" if c in _V or c == "y" and i and w[i - 1] not in _V else "c" for i, c in enumerate(w))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(c in _V or c == "y" and i and w[i - 1] not in _V for i, c in enumerate(w))


def _short_end(w: str) -> bool:
    return len(w) > 2 and w[-1] not in _V + "wxy" and (w[-2] in _V or w[-2] == "y") and w[-3] not in _V


_LONG = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_MID = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem by the published suffix-stripping algorithm of 1980."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in _V + "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_LONG, _MID):
        for end, new in table:
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_LAST, key=len, reverse=True):
        if w.endswith(end):
            body = w[: -len(end)]
            if _measure(body) > 1 and (end != "ion" or body.endswith(("s", "t"))):
                w = body
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def index_terms(text: str) -> list[tuple[str, int]]:
    """(stem, place) of the words that are no stop words; places count all words from 1."""
    return [(stem(w), i) for i, w in enumerate(_WORD.findall(text.lower()), 1) if w not in STOP]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("position", T.IntegerType())])))
def positions(texts: pd.Series) -> pd.Series:
    """The index terms of each text in order; null gives an empty list."""
    return texts.map(lambda t: [{"term": a, "position": b} for a, b in index_terms(t or "")])
