"""Keyword, vector and hybrid retrieval over chunk tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import vectors as VX
from docketry.functions.terms import index_terms, positions
from docketry.functions.text import repair_text, token_estimate
from docketry.operators.relational import first_per_group
from docketry.runtime import head_table

#: Rank constant and channel weights of the reciprocal-rank fusion (fixed values).
RRF_K = 60
WEIGHTS = {"lexical": 0.55, "vector": 0.45, "graph": 0.25}
#: Weights of the LIKE score for a term in the title and in the text (fixed values).
IN_TITLE, IN_BODY = 0.35, 0.08


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions): the inverted index of a chunk table."""
    rows = chunks.select(key, F.explode(positions(text)).alias("p"))
    return rows.groupBy(F.col("p.term").alias("term"), key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("p.position")).alias("positions"))


def query_terms(query: str) -> list[str]:
    """The distinct index terms of a query, in order."""
    return list(dict.fromkeys(t for t, _ in index_terms(query)))


def strict_match(index: DataFrame, key: str, query: str) -> DataFrame:
    """Chunks with all terms of a query and their cover-density rank.

    A cover is a stretch between occurrences of different terms, each the next
    of its kind; every cover adds 1 / its length. Rank is rounded to 6 places.
    """
    words = query_terms(query)
    hits = index.filter(F.col("term").isin(words))
    pairs = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("term").alias("t")))))
    rows = hits.groupBy(key).agg(F.countDistinct("term").alias("n"), F.array_sort(pairs).alias("occ")).filter(F.col("n") == len(words))
    if len(words) == 1:
        return rows.select(key, F.round(F.size("occ").cast("double"), 6).alias("rank"))
    at = F.sequence(F.lit(1), F.size("occ") - 1)
    covers = F.transform(at, lambda i: F.when(F.element_at("occ", i)["t"] != F.element_at("occ", i + 1)["t"], 1.0 / (F.element_at("occ", i + 1)["p"] - F.element_at("occ", i)["p"])).otherwise(0.0))
    return rows.select(key, F.round(F.aggregate(covers, F.lit(0.0), lambda s, x: s + x), 6).alias("rank"))


def must_and_any(index: DataFrame, key: str, must: str, rest: Sequence[str]) -> DataFrame:
    """Chunks with the first term and at least one of the others, and how many occurrences they have."""
    rows = index.filter(F.col("term").isin([must, *rest])).groupBy(key)
    out = rows.agg(F.sum(F.when(F.col("term") == must, F.col("tf"))).alias("first"), F.sum(F.when(F.col("term") != must, F.col("tf"))).alias("others"))
    return out.filter("first > 0 and others > 0").select(key, (F.col("first") + F.col("others")).alias("hits"))


def like_score(title: Column, body: Column, terms: Sequence[str]) -> Column:
    """The sum over terms of what a hit in the title and in the text is worth."""
    one = lambda c, x, w: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x)), w).otherwise(0.0)
    return reduce(lambda a, b: a + b, [one(title, x, IN_TITLE) + one(body, x, IN_BODY) for x in terms], F.lit(0.0))


def hash_embedding(rows: DataFrame, key: str, tokens: Column, dims: int = 384) -> DataFrame:
    """(key, idx, weight): a feature-hash vector in sparse form, of unit length, rounded to 8 places.

    The place of a token is its SHA-256's first four bytes modulo ``dims``, the
    sign the parity of its fifth, the size 1 + min(length, 12) / 12.
    """
    t = rows.select(key, F.explode(tokens).alias("t")).withColumn("h", F.sha2("t", 256))
    place = (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = t.groupBy(key, place.alias("idx")).agg(F.sum(sign * (1 + F.least(F.length("t"), F.lit(12)) / 12.0)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return cells.withColumn("n", length).filter("n > 0").select(key, "idx", F.round(F.col("w") / F.col("n"), 8).alias("weight"))


def exact_neighbours(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """The k rows most similar to one query vector: a scan with a bounded heap per task."""
    scored = rows.withColumn("score", VX.cosine_to(query, F.col(vector))).filter("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(k)


def hamming_then_exact(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int, coarse: int) -> DataFrame:
    """Candidates by the signs' Hamming distance, then the k best of them by cosine."""
    near = rows.select(key, VX.hamming_to(query, F.col(vector)).alias("distance")).filter("distance is not null")
    # the candidates' keys reach the scan as a filter, so that only their vectors are read again
    picked = head_table(near.orderBy("distance", key), coarse)
    there = rows.filter(F.col(key).isin([r[key] for r in picked.select(key).collect()])).join(F.broadcast(picked), key)
    return exact_neighbours(there, key, vector, query, k)


def fused(channels: dict[str, DataFrame], key: str, limit: int) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked channels.

    Each channel has (key, rank, score), rank from 1; a key is listed once per
    channel. Result: (key, hybrid_score, and each channel's score), the best
    ``limit`` by hybrid score, then the channels' scores, then key.
    """
    out = None
    for name, rows in channels.items():
        part = rows.select(key, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
        out = part if out is None else out.join(part, key, "full")
    total = F.lit(0.0)
    for name in channels:
        total = total + F.coalesce(F.lit(WEIGHTS[name]) / (F.lit(float(RRF_K)) + F.col(f"{name}_rank")), F.lit(0.0))
    if "vector" in channels:
        total = total + F.greatest(F.coalesce("vector_score", F.lit(0.0)) - 0.5, F.lit(0.0)) * 0.1
    if "graph" in channels:
        total = total + F.greatest(F.coalesce("graph_score", F.lit(0.0)) - 0.4, F.lit(0.0)) * 0.06
    scores = [F.coalesce(f"{n}_score", F.lit(0.0)).alias(f"{n}_score") for n in channels]
    out = out.select(key, F.round(total, 6).alias("hybrid_score"), *scores)
    return out.orderBy(F.desc("hybrid_score"), *[F.desc(f"{n}_score") for n in channels if n != "lexical"], F.desc("lexical_score"), key).limit(limit)


def gated(rows: DataFrame, overlap: Column, vector_only: Column, score: Column, graph: Column) -> DataFrame:
    """Drop rows that only the vectors found, without a shared term and below .58, and rows nothing supports."""
    weak = vector_only & (overlap == 0) & (score < 0.58)
    none = (overlap == 0) & (graph < 0.2) & ~vector_only
    return rows.filter(~weak & ~none)


def ranked(rows: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """(key, rank, score) of the best ``limit`` rows, ties by key."""
    top = rows.select(key, F.col(score).cast("double").alias("score")).orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())]))
def merge_overlap(parts: pd.Series) -> pd.DataFrame:
    """The parts one after another; what ends one and begins the next is kept once, from 24 characters to 1,200. cut: whether anything was."""

    def merge(texts: Sequence[str]) -> tuple[str, bool]:
        merged, cut = "", False
        for part in texts:
            if not part or not merged:
                merged = merged or part
                continue
            tail, start = merged[-min(len(merged), len(part), 1200) :], part[:24]
            at = tail.find(start) if len(start) == 24 else -1
            while at >= 0 and not part.startswith(tail[at:]):
                at = tail.find(start, at + 1)
            merged += part[len(tail) - at :] if at >= 0 else "\n\n" + part
            cut = cut or at >= 0
        return merged.strip(), cut

    return pd.DataFrame([merge(texts) for texts in parts], columns=["text", "cut"])


def context_windows(seeds: DataFrame | None, chunks: DataFrame, radius: int, budget: int) -> DataFrame:
    """For each seed the neighbours of its section within ``radius``, the seed first, then the nearest, within a token budget.

    ``chunks`` has (id, source_table, source_id, chunk_index, section_title,
    text_content); ``seeds`` has the ids of those to expand, None means all. A
    neighbour of another section is left out, one without a section is not. A
    neighbour that does not fit is skipped and later ones may still be taken; a
    seed over the budget gives no window. Tokens are estimated from the text, and
    merging only lessens them. Returns (seed_id, chunk_ids, text, tokens), chunks
    in their order.
    """
    section = F.lower(F.trim(F.coalesce("section_title", F.lit(""))))
    rows = chunks.filter("chunk_index is not null").select("id", "source_table", "source_id", F.col("chunk_index").cast("int").alias("i"), section.alias("s"), repair_text(F.coalesce("text_content", F.lit(""))).alias("x"))
    rows = rows.withColumn("t", F.when(F.col("x") == "", 0).otherwise(F.greatest(F.lit(1), token_estimate(F.col("x")))).cast("bigint"))
    # one shuffle: texts meet their neighbours in a frame of their document
    frame = Window.partitionBy("source_table", "source_id").orderBy("i").rangeBetween(-radius, radius)
    rows = rows.withColumn("near", F.collect_list(F.struct("i", "id", "s", "t", "x")).over(frame)).select(F.col("id").alias("seed_id"), "i", "s", "near")
    if seeds is not None:
        rows = rows.join(seeds.select(F.col("id").alias("seed_id")).distinct(), "seed_id", "left_semi")
    seed, home, at = F.col("seed_id"), F.col("s"), F.col("i")
    kept = F.filter("near", lambda c: (c["id"] == seed) | (home == "") | (c["s"] == "") | (c["s"] == home))
    order = F.array_sort(F.transform(kept, lambda c: F.struct((c["id"] != seed).cast("int").alias("o"), F.abs(c["i"] - at).alias("d"), c["i"].alias("i"), c["id"].alias("id"), c["t"].alias("t"))))
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("used"))
    took = F.aggregate(order, start, lambda a, c: F.when(a["used"] + c["t"] <= budget, F.struct(F.concat(a["ids"], F.array(c["id"])).alias("ids"), (a["used"] + c["t"]).alias("used"))).otherwise(a))
    rows = rows.withColumn("took", took).filter(F.array_contains("took.ids", seed))
    ids = F.col("took.ids")
    rows = rows.select("seed_id", F.col("took.used").alias("used"), F.array_sort(F.filter("near", lambda c: F.array_contains(ids, c["id"]))).alias("w"))
    out = rows.select("seed_id", "used", F.array_join(F.transform("w", lambda c: c["id"].cast("string")), ",").alias("chunk_ids"), merge_overlap(F.transform("w", lambda c: c["x"])).alias("m"))
    # parts that share nothing have the tokens that were counted before
    tokens = F.when(F.col("m.cut"), token_estimate(F.col("m.text")).cast("bigint")).otherwise(F.col("used"))
    return out.filter(F.col("m.text") != "").select("seed_id", "chunk_ids", F.col("m.text").alias("text"), tokens.alias("tokens"))


def best_per_document(rows: DataFrame, score: str) -> DataFrame:
    """The best row of each document."""
    return first_per_group(rows, ["source_table", "source_id"], [F.desc(score), "id"])
