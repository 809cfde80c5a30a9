"""Sources mixed to target weights (problem 7).

The total of a mix is the largest at which every source can hold its share
within its repeats. A source's budget is first met by whole epochs over all its
documents; what remains is drawn without replacement by Efraimidis-Spirakis
sampling: documents in the order of exponential keys -ln(u)/weight, taken while
the running sum of sizes stays within the budget. The running sum of a source is
never one task's work: sums per key bucket place the cut in one bucket, and only
that bucket is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a source that the row-by-row sum at the cut may touch, about.
AT_CUT = 50_000


def quality(tokens: str = "n_tokens", size: str = "n_bytes"):
    """A document's weight: its bytes per token, as a share of 6, within 0.1 to 1.

    Damaged or unusual text takes more tokens for its bytes and is drawn later.
    """
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col(size) / F.col(tokens) / 6.0))


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source of each mix: its share, what it has, its budget, epochs and rest.

    ``sizes`` has (source, n_tokens), ``targets`` (mix_name, source,
    target_weight, max_repeats). Shares are weights over the sum of a mix's
    weights. A source without documents can hold no share; the others keep their
    relation to one another, and its row says so with an actual share of 0.
    Weights or repeats that are null or not above 0 count as absent.
    """
    has = sizes.groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("has_tokens"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.filter("target_weight > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.sum("target_weight").alias("_w"), F.max("max_repeats").alias("max_repeats"))
    rows = t.join(has, "source", "left").fillna(0, ["has_tokens", "n_docs"])
    per = Window.partitionBy("mix_name")
    usable = F.col("has_tokens") > 0
    rows = rows.withColumn("target_share", F.col("_w") / F.sum("_w").over(per)).withColumn("_share", F.when(usable, F.col("_w")) / F.sum(F.when(usable, F.col("_w"))).over(per))
    rows = rows.withColumn("_total", F.min(F.when(usable, F.col("max_repeats") * F.col("has_tokens") / F.col("_share"))).over(per))
    budget = F.when(usable, F.col("_share") * F.col("_total")).otherwise(0.0)
    rows = rows.withColumn("budget_tokens", budget)
    epochs = F.when(usable, F.least(F.col("max_repeats").cast("bigint"), F.floor(F.col("budget_tokens") / F.col("has_tokens") + 1e-9))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("int"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("budget_tokens") - F.col("epochs") * F.col("has_tokens"))).otherwise(0.0)
    return rows.select("mix_name", "source", "target_share", "max_repeats", "n_docs", "has_tokens", "budget_tokens", "epochs", rest.alias("rest_tokens"))


def mix(sizes: DataFrame, targets: DataFrame, key: str, seed: int = 7, max_targets: int = 10_000) -> DataFrame:
    """(mix_name, source, key, n_tokens, repeats) with repeats of 1 or more.

    ``sizes`` has (key, source, n_tokens, n_bytes) and must be cheap to read
    twice. Documents of a null source, and of sources in no mix, are in none.
    Equal sampling keys are broken by the document's key. More than
    ``max_targets`` target rows are joined by a shuffle instead of a broadcast.
    """
    plan = mix_plan(sizes, targets)
    small = targets.limit(max_targets + 1).count() <= max_targets
    hint = F.broadcast if small else (lambda x: x)
    n = max(1, sizes.count())
    buckets = max(256, min(1 << 20, n // AT_CUT * 16))
    docs = sizes.filter("n_tokens > 0").select(F.col(key).alias("_key"), "source", "n_tokens", quality().alias("_w"))
    drawn = docs.join(hint(plan.select("mix_name", "source", "epochs", "rest_tokens").filter("epochs > 0 or rest_tokens > 0")), "source")
    u = (F.xxhash64("_key", "mix_name", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = drawn.withColumn("_at", -F.log(u) / F.col("_w"))
    drawn = drawn.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("_at") * 0.7)) * buckets)).cast("int"))
    sums = drawn.filter("rest_tokens > 0").groupBy("mix_name", "source", "_bucket").agg(F.sum("n_tokens").alias("_n"), F.first("rest_tokens").alias("_rest"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("mix_name", "source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("_before", before).filter("_before <= _rest and _before + _n > _rest").groupBy("mix_name", "source").agg(F.min("_bucket").alias("_cut"), F.min("_before").alias("_before"))
    marked = drawn.join(hint(cut), ["mix_name", "source"], "left")
    # at the cut the document that brings the sum nearest to the budget is the last
    running = F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, -1))
    edge = marked.filter("_bucket = _cut").withColumn("_take", (F.col("_before") + F.coalesce(running, F.lit(0)) + F.col("n_tokens") / 2 <= F.col("rest_tokens")).cast("int"))
    others = marked.filter("_cut is null or _bucket <> _cut").withColumn("_take", F.when((F.col("rest_tokens") > 0) & (F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut"))), 1).otherwise(0))
    both = edge.unionByName(others).withColumn("repeats", (F.col("epochs") + F.col("_take")).cast("int"))
    return both.filter("repeats > 0").select("mix_name", "source", F.col("_key").alias(key), "n_tokens", "repeats")


def mix_report(sizes: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Target and actual share of every source of every mix; sources that gave nothing have 0."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).cast("bigint").alias("taken_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("repeats").alias("most_repeats"))
    rows = mix_plan(sizes, targets).join(got, ["mix_name", "source"], "left").fillna(0, ["taken_tokens", "docs_used", "most_repeats"])
    total = F.sum("taken_tokens").over(Window.partitionBy("mix_name"))
    return rows.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), F.round(F.when(total > 0, F.col("taken_tokens") / total).otherwise(0.0), 6).alias("actual_share"), "max_repeats", "most_repeats", "n_docs", "docs_used", "has_tokens", "taken_tokens")
