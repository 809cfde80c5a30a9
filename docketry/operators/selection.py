"""Order-dependent choices over ranked rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint

#: Edges still open at which one task decides the rest, with the same result as further rounds.
FINISH = 20_000


def degree_capped(edges: DataFrame, most: int, finish: int = FINISH) -> DataFrame:
    """Edges taken from the most similar down while both ends have fewer than ``most``.

    In rounds: an edge among the first of both its ends, within what these may
    still take, is taken whatever becomes of the edges before it; then edges of
    full nodes are dropped. Each round takes at least the best open edge. At most
    ``finish`` open edges are decided one by one in a single task.
    """
    kinds = dict(edges.dtypes)
    key = ["a", "b", "similarity"]
    rest = edges.select("a", "b", F.col("similarity").cast("double").alias("similarity")).distinct()
    rest = checkpoint(rest.select(*key, F.lit(most).alias("qa"), F.lit(most).alias("qb")))
    # both ends of a loop have one rank, and only the first of a node are shuffled
    w = Window.partitionBy("n").orderBy(F.desc("similarity"), "a", "b")
    parts = []
    while rest.count() > finish:
        ends = rest.select(F.col("a").alias("n"), *key, F.col("qa").alias("q")).unionAll(rest.select(F.col("b").alias("n"), *key, F.col("qb").alias("q")))
        first = ends.withColumn("r", F.rank().over(w)).filter(F.col("r") <= most).filter("r <= q")
        taken = checkpoint(first.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c = 2").select(*key))
        parts.append(taken)
        used = taken.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).cast("int").alias("u"))
        same = reduce(lambda x, y: x & y, [rest[c].eqNullSafe(taken[c]) for c in key])
        rest = rest.join(taken, same, "left_anti")
        for end, q in (("a", "qa"), ("b", "qb")):
            rest = rest.join(used.withColumnRenamed("n", end), end, "left").withColumn(q, F.col(q) - F.coalesce("u", F.lit(0))).drop("u").filter(F.col(q) > 0)
        rest = checkpoint(rest.select(*key, "qa", "qb"))

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        left: dict = {}
        taken = []
        for e in frame.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).itertuples():
            if left.setdefault(e.a, e.qa) > 0 and left.setdefault(e.b, e.qb) > 0:
                left[e.a] -= 1
                left[e.b] -= 1
                taken.append((e.a, e.b, e.similarity))
        return pd.DataFrame(taken, columns=["a", "b", "similarity"])

    last = rest.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(greedy, f"a {kinds['a']}, b {kinds['b']}, similarity double")
    return reduce(DataFrame.unionByName, parts, last)


def covered(rows: DataFrame, kinds: list[str], limit: int) -> DataFrame:
    """The best ``limit`` rows, each wanted kind present if there is any row of it.

    The best unused row of a missing kind replaces the lowest row whose kind has
    more than one row or is not wanted. ``rows`` has (id, kind, score).
    """
    order = [F.desc("score"), F.col("id")]
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("_k") <= limit).drop("_k")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        picked = list(range(min(limit, len(frame))))
        for kind in kinds:
            have = [frame.at[i, "kind"] for i in picked]
            spare = [i for i in range(len(frame)) if i not in picked and frame.at[i, "kind"] == kind]
            if kind in have or not spare:
                continue
            for i in reversed(picked):
                if have.count(frame.at[i, "kind"]) > 1 or frame.at[i, "kind"] not in kinds:
                    picked[picked.index(i)] = spare[0]
                    break
        out = frame.loc[sorted(picked)].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["id", "kind", "score", "rank"]]

    return ranked.select("id", "kind", "score", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(choose, "id bigint, kind string, score double, rank int")
