"""Assembly of records from several tables, numbering, sampling, signatures and queue states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint

#: What stands for "nothing" in the sanctions files (fixed value).
NOTHING = "-0-"


def clean(c: str) -> Column:
    """A column trimmed; null and the sentinel become ''."""
    t = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(t == NOTHING, "").otherwise(t)


def sanctions(entities: DataFrame, addresses: DataFrame, aliases: DataFrame, comments: DataFrame) -> DataFrame:
    """One record for each entity with its addresses, aliases and comment, matched by ent_num.

    entities (ent_num, name, kind, program, remarks), addresses (ent_num, add_num,
    address, city, country), aliases (ent_num, alt_num, name), comments (ent_num,
    remarks). Several comments of an entity are joined by a space in order of
    their text; the entity's own remarks come before them. Lists are in order of
    their numbers; the lists of one entity are its own few rows.
    """
    parts = F.array_join(F.filter(F.array(clean("address"), clean("city"), clean("country")), lambda x: x != ""), ", ")
    places = addresses.select("ent_num", "add_num", parts.alias("p")).filter("p <> ''").groupBy("ent_num").agg(F.array_sort(F.collect_list(F.struct("add_num", "p"))).alias("l"))
    places = places.select("ent_num", F.array_join(F.col("l.p"), "; ").alias("addresses"), F.size("l").alias("n_addresses"))
    others = aliases.select("ent_num", "alt_num", clean("name").alias("p")).filter("p <> ''").groupBy("ent_num").agg(F.array_sort(F.collect_list(F.struct("alt_num", "p"))).alias("l"))
    others = others.select("ent_num", F.array_join(F.col("l.p"), "; ").alias("aliases"), F.size("l").alias("n_aliases"))
    said = comments.select("ent_num", clean("remarks").alias("p")).filter("p <> ''").groupBy("ent_num").agg(F.array_join(F.array_sort(F.collect_list("p")), " ").alias("comment"))
    rows = entities.select("ent_num", clean("name").alias("name"), clean("kind").alias("kind"), clean("program").alias("program"), clean("remarks").alias("remarks"))
    rows = rows.join(places, "ent_num", "left").join(others, "ent_num", "left").join(said, "ent_num", "left").fillna("", ["addresses", "aliases", "comment"]).fillna(0, ["n_addresses", "n_aliases"])
    return rows.select("ent_num", "name", "kind", "program", F.trim(F.concat_ws(" ", "remarks", "comment")).alias("remarks"), "addresses", "n_addresses", "aliases", "n_aliases")


def by_program(records: DataFrame) -> DataFrame:
    """(program, entities, aliases, addresses): an entity of several programs, parted by ; or ], counts in each."""
    names = F.filter(F.transform(F.split("program", r"[;\]]"), lambda x: F.trim(F.regexp_replace(x, r"[\[\]]", ""))), lambda x: x != "")
    rows = records.select("ent_num", "n_aliases", "n_addresses", F.explode(F.array_distinct(names)).alias("program"))
    return rows.groupBy("program").agg(F.count_distinct("ent_num").alias("entities"), F.sum("n_aliases").cast("bigint").alias("aliases"), F.sum("n_addresses").cast("bigint").alias("addresses"))


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in order of a unique ``key``, without a task that holds them all.

    Ranges of the key are sorted each on their own and a row for each range is
    summed up. Pages of a keyset scan are these numbers divided by the page size.
    """
    ranged = checkpoint(rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    # a row per range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def sampled(rows: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """A repeatable sample: the rows whose key's hash lies in the first ``share`` of all hashes, whatever the partitions."""
    place = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return rows.filter(place < int(share * (1 << 32)))


def signature(rows: DataFrame, by: Sequence[str], key: str = "id", at: str = "updated_at") -> DataFrame:
    """(by, n, last_id, last_at): what tells whether a source has changed."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last_id"), F.max(at).alias("last_at"))


def changed_since(now: DataFrame, saved: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, state): 'unchanged' where the signature equals the saved one, else 'changed', 'new' or 'gone'."""
    old = saved.select(*by, F.struct("n", "last_id", "last_at").alias("_old"))
    both = now.select(*by, F.struct("n", "last_id", "last_at").alias("_new")).join(old, list(by), "full")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(*by, state.alias("state"))


def requeue_and_claim(tasks: DataFrame, now: Column, stale: int, most: int, owner: str) -> DataFrame:
    """The queue after one worker's claim: (id, state, owner, leased_at).

    ``tasks`` has (id, state, priority, owner, leased_at). A running task whose
    lease is older than ``stale`` seconds is pending again and has no owner; then
    the ``most`` pending tasks of highest priority, the oldest id first, are
    running, owned and leased now.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("leased_at").cast("timestamp"))
    late = (F.col("state") == "running") & F.coalesce(age > stale * 1_000_000, F.lit(True))
    rows = tasks.withColumn("state", F.when(late, "pending").otherwise(F.col("state")))
    # at most ``most`` rows, found by a bounded heap in each task
    taken = rows.filter("state = 'pending'").orderBy(F.desc("priority"), "id").limit(most).select("id", F.lit(True).alias("_taken"))
    rows = rows.join(F.broadcast(taken), "id", "left")
    mine = F.coalesce("_taken", F.lit(False))
    state = F.when(mine, "running").otherwise(F.col("state"))
    held = F.col("state") == "pending"
    return rows.select("id", state.alias("state"), F.when(mine, F.lit(owner)).when(~held, F.col("owner")).alias("owner"), F.when(mine, now).when(~held, F.col("leased_at")).alias("leased_at"))
