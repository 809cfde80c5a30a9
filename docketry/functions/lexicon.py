"""Dictionaries applied to columns: translation, synonyms, intent, courts, term weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells an intent, tried in this order; the last holds for the rest.
INTENTS = (("lookup", r"(^|[^a-z0-9])(19|20)\d{2} [a-z]{2,6} \d+| v\.? | c\. "), ("compare", r"(^|[^a-z])(compare|versus|difference)($|[^a-z])"), ("guidance", r"(^|[^a-z])(how|what|should|can i|may i)($|[^a-z])|\?"))


def translated(text: Column, glossary: Mapping[str, str], most: int = 12) -> Column:
    """The translations of a glossary's terms in a text, longest term first; what a term covers is used up."""
    pairs = sorted(glossary.items(), key=lambda x: (-len(x[0]), x[0]))
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    start = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast("array<string>").alias("found"))
    taken = lambda s, x: F.struct(F.replace(s["rest"], x["a"], F.lit(" ")).alias("rest"), F.concat(s["found"], F.array(x["b"])).alias("found"))
    return F.aggregate(entries, start, lambda s, x: F.when(F.contains(s["rest"], x["a"]) & (F.size(s["found"]) < most), taken(s, x)).otherwise(s), lambda s: s["found"])


def with_synonyms(terms: DataFrame, key: str, term: str, synonyms: DataFrame) -> DataFrame:
    """(key, term, how): the terms of each key and, marked 'synonym', the other names of them, once each.

    ``synonyms`` has (term, synonym), a row per pair; Spark chooses how it is joined.
    """
    own = terms.select(key, F.lower(term).alias("term")).distinct()
    more = own.join(synonyms.select(F.lower("term").alias("term"), F.lower("synonym").alias("synonym")), "term").select(key, F.col("synonym").alias("term"))
    return own.withColumn("h", F.lit(0)).unionByName(more.withColumn("h", F.lit(1))).groupBy(key, "term").agg(F.min("h").alias("h")).select(key, "term", F.when(F.col("h") == 0, "own").otherwise("synonym").alias("how"))


def intent(text: Column) -> Column:
    """What a text wants: a citation looked up, a comparison, guidance, or a search."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, pattern in INTENTS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("search")


def canonical(rows: DataFrame, alias: Column, names: DataFrame, into: str) -> DataFrame:
    """``rows`` with the one name of an alias; an unknown alias stays as 'raw:' and itself, a blank one is ''.

    ``names`` has (alias, canonical), aliases in lower case with single spaces.
    """
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(alias, F.lit("")))), r"\s+", " ")
    named = rows.withColumn("_key", key).join(names.select(F.col("alias").alias("_key"), "canonical"), "_key", "left")
    return named.withColumn(into, F.when(F.col("_key") == "", "").otherwise(F.coalesce("canonical", F.concat(F.lit("raw:"), "_key")))).drop("_key", "canonical")


def weighted_terms(rows: DataFrame, key: str, text: str, generic: Sequence[str], synonyms: DataFrame, domain: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """(key, term, weight) of every text: quoted, typed, expanded, domain and generic terms; the largest weight of a term counts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    typed = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z][a-z'-]{2,}"), F.lit(0)))).alias("term"))
    plain = F.col("term").isin(*generic)
    first = typed.withColumn("weight", F.when(plain, weights["generic"]).when(F.col("term").isin(*domain), F.lit(max(weights["typed"], weights["domain"]))).otherwise(weights["typed"]))
    more = typed.filter(~plain).join(synonyms, "term").select(key, F.col("synonym").alias("term"), F.lit(weights["expanded"]).alias("weight"))
    quoted = rows.select(key, F.explode(F.regexp_extract_all(low, F.lit('"([^"]+)"'), F.lit(1))).alias("term")).withColumn("weight", F.lit(weights["quoted"]))
    return first.unionByName(more).unionByName(quoted).groupBy(key, "term").agg(F.max("weight").alias("weight"))
