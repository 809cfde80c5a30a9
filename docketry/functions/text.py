"""Column functions over text. Built from expressions; a Pandas UDF only where none can say it."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[ \t\f\x0b\x{a0}]+"
#: Sequences that UTF-8 read as Windows-1252 leaves, with what they stand for.
GARBLED = {"â€™": "’", "â€˜": "‘", "â€œ": "“", "â€“": "–", "â€”": "—", "â€¦": "…", "Â ": " ", "Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã§": "ç", "Ã´": "ô"}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-. ]?)?\(?[2-9][0-9]{2}\)?[-. ][0-9]{3}[-. ][0-9]{4}"
#: Phrases that try to give orders to a reader that is a program.
INJECTION = ("ignore previous instructions", "ignore all previous", "disregard the above", "system prompt", "you are now", "reveal your")


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """HTML entities as their characters; null stays null."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def repair_text(c: Column) -> Column:
    """BOM and NUL dropped, entities unescaped, CRLF and <br> as LF, common garbling mended, blanks squeezed."""
    c = F.regexp_replace(c, "[﻿\x00]", "")
    c = F.when(F.contains(c, F.lit("&")), unescape_html(c)).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?i)<br\s*/?>", "\n")
    for bad, good in GARBLED.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANK, " "), r"\n{3,}", "\n\n"))


def garble_marks(c: Column) -> Column:
    """How many typical sequences of wrongly decoded text a value holds."""
    return F.regexp_count(c, F.lit(r"Ã.|Â.|â€|ï¿½|\x{fffd}"))


def plain_preview(c: Column) -> Column:
    """Text without tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def html_text(c: Column) -> Column:
    """The visible text of HTML: scripts, styles and noscript dropped with their content."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", " ")
    return plain_preview(F.regexp_replace(c, r"(?s)<!--.*?-->", " "))


def split_keywords(c: Column) -> Column:
    """Keywords at commas, semicolons, bars, slashes, new lines and their wide forms; the first of each, case ignored."""
    parts = F.transform(F.split(c, r"[,;|/\n，；、]+"), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x))))


def parse_when(c: Column) -> Column:
    """A timestamp of RFC 822, ISO or plain dates; null if none fits."""
    forms = ("EEE, dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    # the day of the week, which need not agree with the date, says nothing
    bare = F.regexp_replace(c, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms[1:]])


def normal_name(c: Column) -> Column:
    """Lower case, everything but letters, numbers and CJK as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def slug(c: Column, most: int = 120) -> Column:
    """A URL part: lower case ASCII letters and numbers, joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def terms(c: Column, least: int = 3) -> Column:
    """Distinct Latin words of ``least`` letters or more and CJK runs of two or more, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"[a-z][a-z0-9]{{{least - 1},}}|[\x{{4e00}}-\x{{9fff}}]{{2,}}"), F.lit(0))))


def token_estimate(c: Column) -> Column:
    """CJK characters, Latin words and other signs, each as one."""
    return F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_\x{4e00}-\x{9fff}]"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded with two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def bigrams(c: Column) -> Column:
    """Distinct character bigrams of the text without white space, lower case."""
    t = F.regexp_replace(F.lower(c), r"\s+", "")
    n = F.length(t)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2))))).otherwise(F.array(t))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths; null counts as ''."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def script_language(c: Column) -> Column:
    """zh, en or mixed, by the share of CJK among letters."""
    han = F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]"))
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    share = han / F.when(han + latin > 0, han + latin).otherwise(1)
    return F.when(share >= 0.6, "zh").when(share <= 0.1, "en").otherwise("mixed")


def redact(c: Column) -> Column:
    """E-mail addresses and North American phone numbers replaced by marks."""
    # the costly patterns run only over texts that hold what any match must
    mail = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "[email]")).otherwise(c)
    return F.when(c.rlike(r"[0-9][-. ][0-9]{4}"), F.regexp_replace(mail, PHONE, "[phone]")).otherwise(mail)


def injection_marks(c: Column, marks: tuple[str, ...] = INJECTION) -> Column:
    """The marks a text holds, in the order of ``marks``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in marks]))


def highlight(c: Column, term: Column, before: int = 70, after: int = 90) -> Column:
    """The first place of a term with text around it; null if it is absent."""
    at = F.instr(F.lower(c), F.lower(term))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at - start + F.length(term) + after))


def labelled_prefix(parts: dict[str, Column], most: int = 2400) -> Column:
    """'label: value' of the non-blank parts, joined by ' | ' and cut to ``most`` characters."""
    told = [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts.items()]
    return F.substring(F.concat_ws(" | ", *told), 1, most)


def first_text(*columns: Column) -> Column:
    """The first value that is not blank, trimmed; '' if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))
