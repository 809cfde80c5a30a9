"""Knowledge-graph operators: seeding, entry scores, bounded traversal, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.relational import first_per_group
from docketry.runtime import checkpoint

#: What a hop keeps of the score: the first, later ones (fixed values).
FIRST_HOP, LATER_HOP = 0.92, 0.82
LEAST_CONFIDENCE, MOST_HOPS = 0.65, 4


def edge_key(source: Column, target: Column, relation: Column) -> Column:
    """A stable key of an edge."""
    return F.sha2(F.concat_ws("|", source, target, relation), 256)


def undirected(edges: DataFrame) -> DataFrame:
    """(x, y, confidence) both ways; of parallel edges the surest."""
    e = edges.filter(F.col("confidence") >= LEAST_CONFIDENCE).select(F.col("source_id").alias("x"), F.col("target_id").alias("y"), "confidence")
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "confidence")).groupBy("x", "y").agg(F.max("confidence").alias("confidence"))


def entry_scores(entities: DataFrame, query: list[str], limit: int = 8) -> DataFrame:
    """Entities that answer a query's terms: 1.0 same name, .78 phrase in the name, .72 a word of it,
    .65 times the share of a term's words in it; all times .7 + .3 confidence, from .35."""
    name = F.lower("canonical_name")
    words = F.split(name, r"[^a-z0-9]+")
    best = F.lit(0.0)
    for q in query:
        parts = F.array(*[F.lit(w) for w in q.split()])
        part = F.size(F.array_intersect(words, parts)) / len(q.split())
        own = F.when(name == q, 1.0).when(F.lit(" " in q) & F.contains(name, F.lit(q)), 0.78).when(F.array_contains(words, q), 0.72).otherwise(0.65 * F.least(F.lit(1.0), part))
        best = F.greatest(best, own)
    scored = entities.withColumn("score", F.round(best * (0.7 + 0.3 * F.col("confidence")), 6)).filter("score >= 0.35")
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def best_paths(edges: DataFrame, entries: DataFrame, hops: int = 3) -> DataFrame:
    """(node, score, hops): the best product of confidences and hop factors to each node reached.

    Level by level: a hop starts from every node reached by the hop before and
    keeps the best score of each node; a better score replaces a worse one. Ties
    keep the fewer hops. ``entries`` has (node, score).
    """
    both = undirected(edges)
    found = entries.select("node", F.col("score").cast("double").alias("score"), F.lit(0).alias("hops"))
    front = found
    for hop in range(1, min(hops, MOST_HOPS) + 1):
        factor = FIRST_HOP if hop == 1 else LATER_HOP
        step = front.join(both, front["node"] == both["x"]).groupBy(F.col("y").alias("node")).agg(F.max(F.col("score") * F.col("confidence") * factor).alias("score")).withColumn("hops", F.lit(hop))
        front = checkpoint(step)
        found = found.unionByName(front)
    return first_per_group(found, ["node"], [F.desc("score"), "hops"]).select("node", F.round("score", 6).alias("score"), "hops")


def graph_search(paths: DataFrame, links: DataFrame, limit: int = 30) -> DataFrame:
    """Chunks linked to the nodes reached, score = path score times link confidence, the best of each document."""
    rows = links.join(paths.select(F.col("node").alias("entity"), F.col("score").alias("path")), "entity")
    scored = rows.withColumn("score", F.round(F.col("path") * F.col("confidence"), 6))
    return first_per_group(scored, ["document"], [F.desc("score"), "id"]).orderBy(F.desc("score"), "id").limit(limit)
