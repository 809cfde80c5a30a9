"""Names of a list found in texts as whole phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import rows_up_to, spread, widen

#: Most names that every task may hold; more are joined by a shuffle.
BOUND = 200_000


def phrase(c: Column) -> Column:
    """Lower-case words (letters, marks, numbers) with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def names_in_text(texts: DataFrame, names: DataFrame, bound: int = BOUND) -> DataFrame:
    """(kind, id, name_id) for each of ``names`` (name_id, name) that is a whole phrase of a text (kind, id, text).

    A text's words are looked up among the names' first words and the words that
    follow compared, so no text meets all names and no length limits either.
    """
    listed = names.select("name_id", phrase(F.col("name")).alias("p")).filter("p <> ''").distinct()
    plain = widen(texts.select("kind", "id", "text")).select("kind", "id", phrase(F.col("text")).alias("t")).filter("t <> ''")
    known = rows_up_to(listed, bound)
    if known is None:
        return _joined(plain, listed)
    firsts: dict[str, dict[tuple, set]] = {}
    for r in known:
        words = tuple(r["p"].split(" "))
        firsts.setdefault(words[0], {}).setdefault(words, set()).add(r["name_id"])

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, i, text in zip(frame["kind"], frame["id"], frame["t"]):
                words = text.split(" ")
                found: set = set()
                for at, word in enumerate(words):
                    for name, ids in firsts.get(word, {}).items():
                        if tuple(words[at : at + len(name)]) == name:
                            found |= ids
                out += [(kind, i, n) for n in found]
            yield pd.DataFrame(out, columns=["kind", "id", "name_id"])

    types = dict(listed.dtypes) | dict(plain.dtypes)
    return plain.mapInPandas(find, f"kind string, id {types['id']}, name_id {types['name_id']}")


def _joined(plain: DataFrame, listed: DataFrame) -> DataFrame:
    """The same by an equi-join on the first two words of names and of every place in the texts."""
    listed = listed.withColumn("w", F.split("p", " ")).withColumn("two", F.array_join(F.slice("w", 1, 2), " "))
    longest = listed.agg(F.max(F.size("w"))).first()[0] or 1
    words = F.split("t", " ")
    at = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, longest), " "))
    places = spread(plain).select("kind", "id", F.explode(F.array_distinct(at)).alias("s"))
    parts = F.split("s", " ")
    # a name of one word is met by the first word of a place
    keys = places.select("kind", "id", "s", F.explode(F.array_distinct(F.array(parts[0], F.array_join(F.slice(parts, 1, 2), " ")))).alias("two"))
    hit = F.startswith(F.concat("s", F.lit(" ")), F.concat("p", F.lit(" ")))
    return keys.join(listed.select("name_id", "p", "two"), "two").filter(hit).select("kind", "id", "name_id").distinct()
