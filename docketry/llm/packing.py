"""Containers of fixed capacity filled with items (problem 6).

Sum-of-squares packing: an item goes where the sum of the squared numbers of
open containers per residual gap becomes smallest, a new container being one of
the choices; larger items come first, which leaves the small ones for the gaps. Items are spread by the hash of their key over blocks of a bounded
number of items, each packed by one task; the few containers that stay open in a
block are then emptied into one another where their items fit, best gap first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import rows_up_to

#: Items that one task packs.
BLOCK = 25_000
#: Profiles of one call; each is a literal of the plan.
MAX_PROFILES = 1000


#: Containers in a row that cannot be emptied after which the emptying pass ends.
TRIES = 200


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, counted from 0, of each item; every size is at most ``capacity``.

    Ties go to the smallest residual gap, then to an open container over a new
    one, then to the container opened first.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: dict[int, list[int]] = {}
    where = np.empty(len(sizes), dtype=np.int64)
    gaps: list[int] = []
    big = np.iinfo(np.int64).max // 4
    for i, s in enumerate(sizes.tolist()):
        # change of the sum of squares, halved and without its constant, by the gap that is left
        after = np.where(counts[s:] > 0, counts[: capacity - s + 1] - counts[s:] + 1, big)
        if counts[s] > 0:
            after[0] = -counts[s]
        left = int(after.argmin())
        fresh = counts[capacity - s] if s < capacity else -1
        if after[left] <= fresh or after[left] < big and fresh < 0:
            box = by_gap[left + s].pop(0)
            counts[left + s] -= 1
        else:
            left, box = capacity - s, len(gaps)
            gaps.append(capacity)
        gaps[box] = left
        if left:
            counts[left] += 1
            by_gap.setdefault(left, []).append(box)
        where[i] = box
    return _emptied(sizes, where, np.array(gaps, dtype=np.int64), capacity)


def _emptied(sizes: np.ndarray, where: np.ndarray, gaps: np.ndarray, capacity: int, tries: int = TRIES) -> np.ndarray:
    """Empty the least filled containers into the gaps of others where all their items fit.

    Ends after ``tries`` containers in a row that cannot be emptied; the fuller
    ones that follow could be still less.
    """
    order = np.argsort(-gaps, kind="stable")
    items: dict[int, list[int]] = {}
    for i, b in enumerate(where.tolist()):
        items.setdefault(b, []).append(i)
    gone = np.zeros(len(gaps), dtype=bool)
    failed = 0
    for b in order.tolist():
        if failed > tries:
            break
        moved: list[tuple[int, int]] = []
        trial = gaps.copy()
        trial[b] = -1
        for i in sorted(items.get(b, ()), key=lambda i: -sizes[i]):
            fits = np.flatnonzero((trial >= sizes[i]) & ~gone)
            if not len(fits):
                break
            to = int(fits[np.argmin(trial[fits])])
            trial[to] -= sizes[i]
            moved.append((i, to))
        if len(moved) == len(items.get(b, ())):
            for i, to in moved:
                where[i] = to
                items[to].append(i)
            items.pop(b, None)
            gaps = trial
            gone[b] = True
            failed = 0
        else:
            failed += 1
    names = np.cumsum(~gone) - 1
    return names[where]


def pack(sizes: DataFrame, limits: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Assign items to containers for each profile: (profile, container, key, part, n_tokens).

    ``sizes`` has (key, n_tokens), ``limits`` (profile, capacity_tokens). An item
    larger than the capacity is split into parts of the capacity and a rest,
    numbered from 0; every other item is whole, part 0. container is unique in a
    profile. Sizes below 1 or null and capacities below 1 or null give no row;
    repeated keys are packed each. No items give no rows.
    """
    items = sizes.select(F.col(key).alias("_key"), F.col("n_tokens").cast("bigint").alias("_n")).filter("_n > 0")
    blocks = max(1, -(-items.count() // block))
    listed = rows_up_to(limits.select("profile", F.col("capacity_tokens").cast("bigint").alias("_cap")).filter("_cap > 0"), MAX_PROFILES)
    if listed is None:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    profile = F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["_cap"]).cast("bigint").alias("_cap")) for r in listed]) if listed else F.expr("cast(array() as array<struct<profile: string, _cap: bigint>>)")
    parts = items.select("_key", "_n", F.inline(profile)).select(
        "profile", "_cap", "_key", "_n", F.pmod(F.xxhash64("_key", F.lit("block")), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / F.col("_cap")).cast("int"))).alias("part")
    )
    parts = parts.withColumn("n_tokens", F.least(F.col("_cap"), F.col("_n") - F.col("part") * F.col("_cap")))
    full = F.col("n_tokens") == F.col("_cap")
    kind = dict(items.dtypes)["_key"]
    # a full part is a container of its own: it needs no task's memory and no place in a block
    alone = parts.filter(full).select("profile", F.concat_ws("-", F.lit("f"), F.col("_key").cast("string"), "part").alias("container"), "_key", "part", "n_tokens")

    def one(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "_mix", "_key", "part"], ascending=[False, True, True, True], kind="stable")
        boxes = sum_of_squares(frame["n_tokens"].to_numpy(), int(frame["_cap"].iloc[0]))
        return pd.DataFrame({"profile": frame["profile"], "container": [f"{group[1]}-{b}" for b in boxes], "_key": frame["_key"], "part": frame["part"], "n_tokens": frame["n_tokens"]})

    rest = parts.filter(~full).withColumn("_mix", F.xxhash64("_key", "part")).select("profile", "_block", "_cap", "_key", "part", "n_tokens", "_mix")
    packed = rest.groupBy("profile", "_block").applyInPandas(one, f"profile string, container string, _key {kind}, part int, n_tokens bigint")
    return packed.unionByName(alone).select("profile", "container", F.col("_key").alias(key), "part", "n_tokens")
