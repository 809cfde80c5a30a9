"""Relational patterns Spark has no single call for: first per group, upserts, merges, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import spread


def _columns(names: Sequence) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_group(rows: DataFrame, by: Sequence, order: Sequence, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their rank if a name is given.

    Catalyst turns the filter on the rank into a limit per group before the shuffle.
    """
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*_columns(by)).orderBy(*_columns(order)))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence) -> DataFrame:
    """``old`` overlaid by ``new``: per key the row with the highest version, the new one on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [c.desc_nulls_last() for c in _columns(version)]
    return first_per_group(both, keys, [*order, F.col("_new").desc()]).drop("_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it does not have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``old`` with all children of the parents in ``new`` replaced by those of ``new``."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").unionByName(new)


def missing_or_stale(rows: DataFrame, made: DataFrame, key: str, stale: Column) -> DataFrame:
    """Rows without a counterpart in ``made``, or whose counterpart is stale."""
    return rows.join(made, key, "left").filter(F.col("_made").isNull() | stale)


def exact_else_fallback(exact: DataFrame, fallback: DataFrame) -> DataFrame:
    """``exact``, or ``fallback`` if ``exact`` is empty; the test is a one-row aggregate."""
    empty = F.broadcast(exact.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0"))
    return exact.unionByName(fallback.join(empty.select(F.lit(1).alias("_go")), F.lit(True), "left_semi"))


def running_distinct_cap(rows: DataFrame, value: str, order: Sequence, most: int) -> DataFrame:
    """The rows in order up to the first at which ``most`` distinct values have been seen.

    The first row of each value gets a flag by a group of its own; only the
    flagged rows, of which ``most`` are kept, are ordered globally, and the row
    order at the last of them bounds the result.
    """
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    firsts = first_per_group(rows, [value], order).select(*keys)
    names = [f"_o{i}" for i in range(len(order))]
    head = firsts.orderBy(*names).limit(most)
    last = head.agg(F.max(F.struct(*names)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(last), (F.col("_n") < most) | (F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)]) <= F.col("_last"))).drop("_last", "_n")


def alias_merged_counts(rows: DataFrame, code: Column, aliases: DataFrame) -> DataFrame:
    """Counts per code, merged through (alias, canonical); codes without an alias stay as 'raw:' and the code."""
    counts = rows.groupBy(code.alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(aliases, "alias", "left").select(F.coalesce("canonical", F.concat(F.lit("raw:"), "alias")).alias("canonical"), "n")
    return named.groupBy("canonical").agg(F.sum("n").alias("n"))


def floor_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group and each named share the value at the floored index of its sorted values (exact).

    Counts of each distinct value, which are combined before the shuffle, are
    summed up in order of value; no group is ever held as a list.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda p: F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()])


def merge_duplicates(rows: DataFrame, by: Sequence, best: Sequence, sums: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """Each row with its rank in its group of duplicates, and the group's sums, minima and maxima."""
    w = Window.partitionBy(*_columns(by))
    out = rows.withColumn("keeper_rank", F.row_number().over(w.orderBy(*_columns(best))))
    for c in sums:
        out = out.withColumn(f"sum_{c}", F.sum(c).over(w))
    for c in least:
        out = out.withColumn(f"min_{c}", F.min(c).over(w))
    for c in most:
        out = out.withColumn(f"max_{c}", F.max(c).over(w))
    return out.withColumn("is_duplicate", F.col("keeper_rank") > 1)


def neighbour_window(seeds: DataFrame, rows: DataFrame, keys: Sequence[str], index: str, radius: int) -> DataFrame:
    """Rows within ``radius`` places of each seed in the same document, by an equi-join on place."""
    near = seeds.withColumn("_at", F.explode(F.sequence(F.col(index) - radius, F.col(index) + radius))).withColumnRenamed(index, "seed_index")
    return near.join(rows.withColumn("_at", F.col(index)), [*keys, "_at"]).withColumn("distance", F.col(index) - F.col("seed_index")).drop("_at")


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` does not have, once each."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def cooldown_sessions(events: DataFrame, by: Sequence[str], at: str, order: str, seconds: int) -> DataFrame:
    """Number the tasks of each group: an event more than ``seconds`` after the one before starts a new one."""
    w = Window.partitionBy(*by).orderBy(at, order)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return events.withColumn("task_no", F.sum(F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def placed(rows: DataFrame, order: Sequence, name: str) -> DataFrame:
    """The rows of a short list, of which every group was limited before, numbered from 1."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*_columns(order))))


def _ordered_items(rows: DataFrame, key: str, item: str, counts: DataFrame) -> DataFrame:
    """(key, item, _n, _r): items of each set from the rarest on, numbered from 1, with the set's size."""
    w = Window.partitionBy(key)
    return rows.join(counts, item).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy("_df", item)))


def similar_sets(rows: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, na, nb, common), a < b: the pairs of keys whose sets of items have a Jaccard coefficient of ``least`` or more.

    Sets so similar share one of their rarest items: of a set of n items those
    beyond n - ceil(least * n) + 1 make no pair, so an item that many sets have
    is met only by the small sets it is among the rarest of. Exact.
    """
    sets = rows.select(key, item).filter(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    placed = _ordered_items(sets, key, item, sets.groupBy(item).agg(F.count(F.lit(1)).alias("_df")))
    head = placed.filter(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1)
    x = head.select(item, F.col(key).alias("a"), F.col("_n").alias("na"))
    y = head.select(item, F.col(key).alias("b"), F.col("_n").alias("nb"))
    met = x.join(y, item).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)).select("a", "b", "na", "nb").distinct()
    # a key's own items, as one array
    own = sets.groupBy(key).agg(F.collect_set(item).alias("_items"))
    both = met.join(own.select(F.col(key).alias("a"), F.col("_items").alias("_x")), "a").join(own.select(F.col(key).alias("b"), F.col("_items").alias("_y")), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("_x", "_y")).alias("common"))
    return both.filter(F.col("common") >= (F.col("na") + F.col("nb") - F.col("common")) * least - 1e-9)


def similar_keys(rows: DataFrame, key: str, item: str, least: float, digits: int, per: int = 1024) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of keys as in ``similar_sets``, where many keys may have equal sets.

    Keys with equal sets are folded into one set, named by its least key; only
    these are compared, by counts of shared items. Their keys are kept in lists of about ``per``, and pairs
    of lists are spread over the tasks and written out there, so a set that most
    keys have is no hot key and every row made is a row of the result. Exact;
    the similarity is rounded to ``digits`` places after the comparison. Keys
    with null items only have empty sets: 0 / 0, NaN, between any two of them.
    """
    sets = rows.select(F.col(key).alias("_key"), F.col(item).alias("_item")).filter("_key is not null").distinct()
    own = sets.groupBy("_key").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    folded = own.groupBy("_items").agg(F.min("_key").alias("_set"), F.count(F.lit(1)).alias("_keys"))
    lists = own.join(folded, "_items").groupBy("_set", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_keys") / per)).alias("_part")).agg(F.sort_array(F.collect_list("_key")).alias("_list"))
    a, b = (folded.select(F.explode("_items").alias("_item"), F.col("_set").alias(n), F.size("_items").alias(f"n{n}")) for n in "ab")
    met = a.join(b, "_item").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.col("_c") / (F.col("na") + F.col("nb") - F.col("_c")))
    met = met.filter(F.col("_s") >= least).select("a", "b", F.round("_s", digits).alias("similarity")).unionByName(folded.filter("_keys > 1").select(F.col("_set").alias("a"), F.col("_set").alias("b"), F.when(F.size("_items") > 0, 1.0).otherwise(float("nan")).alias("similarity")))
    x, y = (lists.select(F.col("_set").alias(n), F.col("_part").alias(f"_p{n}"), F.col("_list").alias(f"_l{n}")) for n in "ab")
    both = met.join(x, "a").join(y, "b").filter("a < b or _pa <= _pb").select("similarity", F.expr("a = b and _pa = _pb").alias("_one"), "_la", "_lb")
    # one key's partners as a list of their own: so many rows are made at a time, not those of two whole lists
    one = spread(both).select("similarity", "_one", "_lb", F.explode("_la").alias("_x"))
    one = one.select("similarity", "_x", F.when(F.col("_one"), F.filter("_lb", lambda y: y > F.col("_x"))).otherwise(F.col("_lb")).alias("_lb"))
    out = one.select("similarity", "_x", F.explode("_lb").alias("_y"))
    return out.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


def sharing_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str, item: str, least: int) -> DataFrame:
    """(left_key, right_key, common) of the pairs whose sets share at least ``least`` items.

    The ``least - 1`` commonest items of a set make no pair by themselves. Exact.
    """
    l, r = (s.select(k, item).filter(F.col(k).isNotNull() & F.col(item).isNotNull()).distinct() for s, k in ((left, left_key), (right, right_key)))
    counts = l.select(item).unionByName(r.select(item)).groupBy(item).agg(F.count(F.lit(1)).alias("_df"))
    heads = [_ordered_items(s, k, item, counts).filter(F.col("_r") <= F.col("_n") - least + 1).select(k, item) for s, k in ((l, left_key), (r, right_key))]
    met = heads[0].join(heads[1], item).select(left_key, right_key).distinct()
    both = met.join(l.groupBy(left_key).agg(F.collect_set(item).alias("_x")), left_key).join(r.groupBy(right_key).agg(F.collect_set(item).alias("_y")), right_key)
    return both.select(left_key, right_key, F.size(F.array_intersect("_x", "_y")).alias("common")).filter(F.col("common") >= least)
