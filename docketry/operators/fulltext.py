"""Full-text search over an inverted index that is kept as a table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.relational import exact_else_fallback
from docketry.runtime import checkpoint_dir

#: Runs of letters and digits; the same in the index, in queries and in SQL.
WORD = r"[\p{L}\p{N}]+"
#: Terms a fallback query uses at most (fixed value).
FALLBACK_TERMS = 8
Phrase = tuple[str, ...]


@dataclass
class Group:
    """What one alternative of a query asks for: all of ``wanted``, none of ``barred``."""

    wanted: list[Phrase] = field(default_factory=list)
    barred: list[Phrase] = field(default_factory=list)


def words_of(text: str) -> Phrase:
    """The index terms of a text, in order."""
    return tuple(re.findall(r"[^\W_]+", text.replace("İ", "i").lower()))


def parse(query: str) -> list[Group]:
    """A web-style query: words and "phrases" that must all occur, -those that must not, or between alternatives.

    "or" binds less than what stands side by side. A word that holds several
    terms, such as "l'appel", is a phrase of them. An alternative that wants
    nothing matches nothing and is left out.
    """
    groups = [Group()]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            groups.append(Group())
        elif terms := words_of(quoted or word):
            (groups[-1].barred if minus else groups[-1].wanted).append(terms)
    return [g for g in groups if g.wanted]


def index(rows: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(term, key, tf, positions) of every term of every text; null and empty texts have none."""
    # the capital whose small form is two characters is taken as its plain one
    body = F.translate(F.col(text) if isinstance(text, str) else text, "İ", "i")
    terms = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(WORD), F.lit(0))
    posts = rows.select(F.col(key), F.posexplode(terms).alias("position", "term"))
    return posts.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def keep(postings: DataFrame, folder: str | None = None) -> DataFrame:
    """The index written in order of terms, so that a search reads the row groups of its terms only."""
    spark = postings.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    postings.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", 8 << 20).parquet(folder)
    return spark.read.parquet(folder)


def match(postings: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score) of the texts that a query matches; score sums 1 + ln(occurrences) of its wanted terms.

    Only the query's terms are read; of a text at most as many rows meet as the
    query has terms. A query that wants nothing matches nothing.
    """
    groups = parse(query)
    wanted = sorted({t for g in groups for p in g.wanted for t in p})
    terms = sorted({t for g in groups for p in (*g.wanted, *g.barred) for t in p})
    at = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    rows = postings.filter(F.col("term").isin(terms)).groupBy(key).agg(at.alias("at"))

    def has(phrase: Phrase) -> Column:
        first, *rest = (F.try_element_at("at", F.lit(t)) for t in phrase)
        if not rest:
            return first.isNotNull()
        follows = F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(r, p + i), F.lit(False)) for i, r in enumerate(rest, 1)]))
        return F.coalesce(follows, F.lit(False))

    whole = [reduce(lambda a, b: a & b, [has(p) for p in g.wanted] + [~has(p) for p in g.barred]) for g in groups]
    worth = [F.coalesce(1 + F.log(F.size(F.try_element_at("at", F.lit(t))).cast("double")), F.lit(0.0)) for t in wanted]
    score = reduce(lambda a, b: a + b, [F.when(F.try_element_at("at", F.lit(t)).isNotNull(), w).otherwise(0.0) for t, w in zip(wanted, worth)], F.lit(0.0))
    return rows.filter(reduce(lambda a, b: a | b, whole, F.lit(False))).select(key, F.round(score, 6).alias("score"))


def fallback_terms(query: str, generic: Collection[str] = ()) -> list[str]:
    """The terms of a fallback: the first must occur and one of the others; generic ones count only where no other is left."""
    terms = list(dict.fromkeys(t for g in parse(query) for p in g.wanted for t in p))
    return ([t for t in terms if t not in generic] or terms)[:FALLBACK_TERMS]


def match_any(postings: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score) of the texts with the first term and at least one of the others, if there are others."""
    must, rest = terms[:1], terms[1:]
    rows = postings.filter(F.col("term").isin(terms)).groupBy(key)
    out = rows.agg(F.max(F.col("term").isin(must)).alias("first"), F.max(F.col("term").isin(rest)).alias("other"), F.round(F.sum(1 + F.log(F.col("tf").cast("double"))), 6).alias("score"))
    return out.filter("first and other" if rest else "first").select(key, "score")


def search(postings: DataFrame, rows: DataFrame, key: str, query: str, where: Column | None = None, limit: int = 30, generic: Collection[str] = (), newest: str = "published_at") -> DataFrame:
    """The best ``limit`` rows for a query: the exact matches within ``where``, or, if there are none, those of the fallback.

    Ordered by score, then newest first, then key; rows without a score are none.
    """
    picked = rows if where is None else rows.filter(where)
    picked = picked.select(key, newest)
    exact = match(postings, key, query).join(picked, key)
    terms = fallback_terms(query, generic)
    either = exact_else_fallback(exact, match_any(postings, key, terms).join(picked, key)) if terms else exact
    return either.filter("score > 0").orderBy(F.desc("score"), F.desc_nulls_last(newest), key).limit(limit)
