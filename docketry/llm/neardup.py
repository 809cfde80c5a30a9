"""Records that are nearly the same text (problem 2).

Signature-coordinate inverted join. A record's signature has COORDINATES
coordinates, each the hash of ROWS minima of its shingle hashes, so that two
records of similarity s agree in a coordinate with probability s ** ROWS. The
records are posted under each (coordinate, value) pair; a list of one record is
skipped. Collisions are counted by merging the lists: only the prefix of
COORDINATES - MATCHES + 1 coordinates, a record's rarest first, makes candidates,
since a pair with MATCHES agreements must agree in the prefix of both; the other
lists, the long ones, only add to the counts of pairs that are candidates
already. Pairs with MATCHES agreements are then checked exactly.

Records with equal shingle sets are folded into one class first, so copies never
meet in a list; ``near_duplicates`` returns a row per record with its class, and
pairs of class representatives, and ``expand_pairs`` turns these into all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, widen

#: Words of a shingle, fewest words of a record, similarity from which a pair counts.
SHINGLE, LEAST_TOKENS, THRESHOLD = 3, 40, 0.5
#: Coordinates of a signature, minima in each, and agreements that make a candidate.
#: At a similarity of 0.5 a pair is missed with probability 0.013, at 0.6 with 0.0001.
COORDINATES, ROWS, MATCHES = 48, 3, 2
#: Records of a list from which it is merged in slices.
LONG = 2_000
#: Records in pairs up to which their ids are broadcast (8 bytes each).
MOST_SENT = 1_000_000

_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=200_000)
def _token(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tokens(text: str) -> list[str]:
    """Every single Chinese character, and every longest run of other letters and numbers, in lower case."""
    return _TOKEN.findall(text.lower())


def shingles(text: str, width: int = SHINGLE, least: int = LEAST_TOKENS) -> np.ndarray | None:
    """The sorted distinct hashes of all runs of ``width`` tokens; None for a shorter record than ``least``."""
    words = tokens(text)
    if len(words) < max(least, width):
        return None
    h = np.fromiter(map(_token, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=8)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([xxhash.xxh3_64_intdigest(f"coordinate {i}") for i in range(n)], dtype=np.uint64)
    return (h >> np.uint64(32)).astype(np.uint32)[:, None], (h.astype(np.uint32) | np.uint32(1))[:, None]


def signature(hashes: np.ndarray, coordinates: int = COORDINATES, rows: int = ROWS) -> np.ndarray:
    """``coordinates`` values of 64 bits, each made of ``rows`` minima and its own number."""
    flip, times = _seeds(coordinates * rows)
    h = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.empty(coordinates * rows, dtype=np.uint64)
    step = max(1, 60_000 // max(1, h.shape[1]))
    with np.errstate(over="ignore"):
        for lo in range(0, len(least), step):
            least[lo : lo + step] = ((h ^ flip[lo : lo + step]) * times[lo : lo + step]).min(axis=1)
        out = np.arange(coordinates, dtype=np.uint64) * _MIX
        for k in range(rows):
            out = (out ^ least[k::rows]) * _MIX
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def content(title: str = "title", text: str = "raw_text"):
    """Title, a space, text; null counts as ''."""
    return F.concat(F.coalesce(F.col(title).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(rows: DataFrame, key: str, text, width: int = SHINGLE, least: int = LEAST_TOKENS) -> DataFrame:
    """(_id, _class, _sig) of every record with enough tokens; _class is equal for equal shingle sets."""
    picked = widen(rows.select(F.col(key).alias("_id"), text.alias("_text")).filter("_id is not null"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, classes, sigs = [], [], []
            for i, t in zip(batch["_id"].tolist(), batch["_text"]):
                h = shingles(t, width, least)
                if h is not None:
                    ids.append(i)
                    classes.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sigs.append(signature(h))
            if ids:
                yield pd.DataFrame({"_id": ids, "_class": classes, "_sig": sigs})

    return picked.mapInPandas(look, f"_id {dict(picked.dtypes)['_id']}, _class binary, _sig array<bigint>")


def candidates(signed: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, long: int = LONG) -> DataFrame:
    """Pairs (_a < _b) of ids that agree in at least ``matches`` coordinates.

    ``signed`` has one row per class: (_id, _sig). The postings of coordinates
    shared by two records or more are kept with the length of their list, and
    each record's prefix is chosen among them by that length. Lists are merged
    prefix with prefix, and prefix with the few postings beyond it; of a value
    that is beyond the prefix of all its records no pair is ever made. A list of
    more than ``long`` records is merged in as many slices.
    """
    posts = signed.select("_id", F.explode("_sig").alias("_value"))
    shared = posts.groupBy("_value").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    kept = posts.join(shared, "_value")
    # values that no other record has are the rarest and fill the prefix first
    alone = F.lit(coordinates) - F.count(F.lit(1)).over(Window.partitionBy("_id"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_df", "_value"))
    kept = kept.withColumn("_in", rank + alone <= coordinates - matches + 1)
    # at most matches - 1 values of a record are beyond its prefix
    kept = kept.withColumn("_out", F.collect_list(F.when(~F.col("_in"), F.col("_value"))).over(Window.partitionBy("_id")))
    kept = checkpoint(kept.select("_id", "_value", "_in", "_out", F.ceil(F.col("_df") / F.lit(long)).cast("int").alias("_slices")))
    slice_of = F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int").alias("_slice")
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")

    def merged(left: DataFrame, right: DataFrame, both: bool) -> DataFrame:
        # the left postings go to every slice of their list, the right ones to their own
        a = left.select("_value", every, F.col("_id").alias("_x"), F.col("_out").alias("_ox"))
        b = right.select("_value", slice_of, F.col("_id").alias("_y"), F.col("_out").alias("_oy"))
        hits = a.join(b, ["_value", "_slice"]).filter("_x < _y" if both else "_x <> _y")
        return hits.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b"), F.lit(both).alias("_both"), F.size(F.array_intersect("_ox", "_oy")).alias("_rest"))

    prefix = kept.filter("_in")
    hits = merged(prefix, prefix, True)
    if matches > 1:
        hits = hits.unionByName(merged(prefix, kept.filter("not _in"), False))
    counted = hits.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_both").alias("_both"), F.max("_rest").alias("_rest"))
    # a pair must meet in both prefixes; agreements beyond both are added
    return counted.filter(F.col("_both") & (F.col("_n") + F.col("_rest") >= matches)).select("_a", "_b")


def _zipped(text: str) -> bytes:
    return pa.compress(text.encode(), codec="zstd", asbytes=True)


def verified(rows: DataFrame, key: str, text, pairs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(_a, _b, similarity) of the pairs whose exact Jaccard coefficient reaches ``threshold``.

    The texts are read once more, those of records in a pair are sent compressed
    to their pairs, and the shingles are made where the pair is compared. The ids
    of these records are broadcast up to MOST_SENT; more are joined by a shuffle.
    """
    kind = dict(pairs.dtypes)["_a"]
    wanted = checkpoint(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct())
    wanted = F.broadcast(wanted) if kind in ("bigint", "int") and wanted.count() <= MOST_SENT else wanted
    texts = rows.select(F.col(key).alias("_id"), text.alias("_text")).join(wanted, "_id", "left_semi")

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_zip": [_zipped(t) for t in batch["_text"]], "_size": [len(t.encode()) for t in batch["_text"]]})

    # rows that repeat a key have the same text; both joins use the one shuffle that leaves a row for each key
    sent = checkpoint(texts.mapInPandas(zipped, f"_id {kind}, _zip binary, _size int")).dropDuplicates(["_id"])
    left, right = (sent.select(F.col("_id").alias(f"_{x}"), F.col("_zip").alias(f"_z{x}"), F.col("_size").alias(f"_n{x}")) for x in "ab")
    both = pairs.join(left, "_a").join(right, "_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            out = []

            def of(i, z, n) -> np.ndarray:
                if i not in held:
                    if len(held) > 500:
                        held.clear()
                    held[i] = shingles(pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True).decode(), width, 0)
                return held[i]

            for r in batch.itertuples(index=False):
                x, y = of(r[0], r[2], r[3]), of(r[1], r[4], r[5])
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(common / (len(x) + len(y) - common))
            yield pd.DataFrame({"_a": batch["_a"], "_b": batch["_b"], "similarity": out})

    both = both.select("_a", "_b", "_za", "_na", "_zb", "_nb")
    return both.mapInPandas(compare, f"_a {kind}, _b {kind}, similarity double").filter(F.col("similarity") >= threshold)


def near_duplicates(rows: DataFrame, key: str, text, threshold: float = THRESHOLD, width: int = SHINGLE, least: int = LEAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records and the near-duplicate pairs between them.

    Returns (members, pairs): members (key, class_id), a row per record that
    takes part, where class_id is the smallest key of the records with the same
    shingle set; pairs (class_a, class_b, similarity), class_a < class_b.

    Records with a null key or fewer than ``least`` tokens take no part; null
    text counts as ''. Rows that repeat a key with the same text are one record.
    Columns
    besides the key and those of ``text`` are ignored. An empty table gives none.
    """
    signed = checkpoint(signatures(rows, key, text, width, least))
    classes = signed.groupBy("_class").agg(F.min(F.struct("_id", "_sig")).alias("_r")).select("_class", F.col("_r._id").alias("_id"), F.col("_r._sig").alias("_sig"))
    members = signed.select("_id", "_class").join(classes.select("_class", F.col("_id").alias("class_id")), "_class").select(F.col("_id").alias(key), "class_id").distinct()
    pairs = verified(rows, key, text, checkpoint(candidates(classes)), threshold, width)
    return members, pairs.select(F.col("_a").alias("class_a"), F.col("_b").alias("class_b"), "similarity")


def expand_pairs(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """All pairs of records (item_a < item_b, similarity) behind classes and class pairs."""
    left = members.select("class_id", F.col(key).alias("item_a"))
    right = members.select("class_id", F.col(key).alias("item_b"))
    same = left.join(right, "class_id").filter("item_a < item_b").select("item_a", "item_b", F.lit(1.0).alias("similarity"))
    linked = pairs.join(left.withColumnRenamed("class_id", "class_a"), "class_a").join(right.withColumnRenamed("class_id", "class_b"), "class_b")
    low, high = F.least("item_a", "item_b"), F.greatest("item_a", "item_b")
    return same.unionByName(linked.filter("item_a <> item_b").select(low.alias("item_a"), high.alias("item_b"), "similarity"))
