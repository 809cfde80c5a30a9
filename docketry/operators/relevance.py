"""Scores of links, relations and evidence as column expressions (constants are fixed values)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much a reference counts by what is done with it.
RELATION = {"cited": 1.0, "applied": 0.9, "explained": 0.8, "distinguished": 0.7, "related": 0.6}
#: Words around a reference that tell its kind, tested in this order.
RELATION_WORDS = (("applied", ("applied", "applying", "applies")), ("explained", ("interpreted", "explained", "described")), ("distinguished", ("distinguished", "contrary to")), ("cited", ("pursuant to", "cited", "under", "relied on")))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number within limits."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def relation_type(context: Column) -> Column:
    """What a text does with what it refers to."""
    low = F.lower(F.coalesce(context, F.lit("")))
    out = None
    for name, words in RELATION_WORDS:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("related")


def relation_score(kind: Column, name: Column) -> Column:
    """The weight of a relation and a bonus for long names, at most 1."""
    base = F.create_map(*[F.lit(x) for kv in RELATION.items() for x in kv])[kind]
    n = F.length(name)
    return F.round(F.least(base + F.when(n > 20, 0.05).otherwise(0.0) + F.when(n > 40, 0.05).otherwise(0.0), F.lit(1.0)), 4)


def link_score(official: Column, by: Column, occurrences: Column) -> Column:
    """How sure a link is: by title, citation or alias, more for each further occurrence, at most .99."""
    base = F.when(by == "title", F.when(official, 0.97).otherwise(0.88)).when(by == "citation", 0.95).otherwise(F.when(official, 0.92).otherwise(0.83))
    return F.round(F.least(base + F.least(F.lit(0.03), 0.01 * (occurrences - 1)), F.lit(0.99)), 4)


def weighted_terms(fields: Sequence[tuple[Column, float]], terms: dict[str, float], prefix: int | None = None) -> Column:
    """Field weight times term weight times a damped count, over the root of the field's length.

    Only the first ``prefix`` characters of each field are looked at, if it is given.
    """
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def worth(low: Column, term: str, w: float) -> Column:
        n = (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)
        return F.when(F.contains(low, F.lit(term)), let(n, lambda n: w * (1 + F.log1p(F.least(n, F.lit(4.0)))))).otherwise(0.0)

    def scored(weight: float, low: Column) -> Column:
        length = F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.lit(80), F.length(low)) / 420.0))
        return sum((worth(low, t, weight * w) for t, w in terms.items()), F.lit(0.0)) / length

    total = F.lit(0.0)
    for field, weight in fields:
        text = F.coalesce(field, F.lit(""))
        low = F.lower(text if prefix is None else F.substring(text, 1, prefix))
        # the small letters of a field are made once for all terms
        total = total + let(low, partial(scored, weight))
    return total


def normalised(score: Column, top: int) -> Column:
    """A score on a logarithmic scale to ``top``, within 0 and 1."""
    return clamp(F.log1p(score) / F.log1p(F.lit(float(top))))


def capped(score: Column, caps: Sequence[tuple[Column, float]]) -> Column:
    """A score within the lowest of the caps whose condition holds, at least .05."""
    limit = F.least(F.lit(1.0), *[F.when(cond, cap).otherwise(1.0) for cond, cap in caps])
    return F.round(F.least(F.greatest(score, F.lit(0.05)), limit), 4)


def risk_level(warnings: Column, risks: Column, confidence: Column) -> Column:
    """high, medium or low."""
    high = (warnings >= 2) | (risks >= 4) | (confidence < 0.35)
    return F.when(high, "high").when((warnings == 1) | (risks >= 2) | (confidence < 0.55), "medium").otherwise("low")


def sigmoid(x: Column, slope: float = 4.0, middle: float = 0.5) -> Column:
    """1 / (1 + e ** -(slope (x - middle)))."""
    return 1.0 / (1.0 + F.exp(-slope * (x - middle)))
