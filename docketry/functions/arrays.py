"""Column functions over arrays: set similarities, vectors, ranking measures. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """|A and B| / min(|A|, |B|); 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """The dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length in double."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a length differs or one is empty, a zero norm divides by 1."""
    na, nb = norm(a), norm(b)
    safe = F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / safe).otherwise(F.lit(0.0))


def sign_words(a: Column, dims: int, width: int = 32) -> list[Column]:
    """The signs of a vector's components, packed into numbers of ``width`` bits."""
    out = []
    for lo in range(0, dims, width):
        part = F.slice(a, lo + 1, min(width, dims - lo))
        out.append(F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0).cast("bigint")))
    return out


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two packed sign vectors."""
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def unique(a: Column) -> Column:
    """First of each value, nulls and blanks dropped, order kept."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != "")))


def recall_at(expected: Column, ranked: Column, k: int) -> Column:
    """The share of the expected ids among the first ``k`` ranked; 0 if none is expected."""
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, F.size(F.array_intersect(expected, F.slice(ranked, 1, k))) / n).otherwise(0.0)


def reciprocal_rank(expected: Column, ranked: Column) -> Column:
    """1 / place of the first expected id; 0 if there is none."""
    first = F.array_min(F.filter(F.transform(expected, lambda x: F.array_position(ranked, x)), lambda p: p > 0))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def ndcg_at(expected: Column, ranked: Column, k: int) -> Column:
    """Normalised discounted cumulative gain with relevance 0 or 1."""
    places = F.sequence(F.lit(1), F.lit(k))
    gain = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.when(F.array_contains(expected, F.try_element_at(ranked, i)), F.lit(1.0) / F.log2(i + 1)).otherwise(0.0))
    hits = F.least(F.size(F.array_distinct(expected)), F.size(ranked), F.lit(k))
    ideal = F.aggregate(F.when(hits > 0, F.sequence(F.lit(1), hits)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return F.when(ideal > 0, F.coalesce(gain, F.lit(0.0)) / ideal).otherwise(0.0)
