"""Snapshots of evidence: who may see it, what is redacted, the hash of what remains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X


def snapshots(items: DataFrame, table: str, acl: Sequence[str] = ()) -> DataFrame:
    """(id, snapshot, state) of the items (id, source_uid, raw_text) that ``acl`` allows by uid or table:id; an empty one allows all.

    The hash is that of the whole text after redaction, so any change of what
    may be shown changes it.
    """
    allowed = sorted({v.strip() for v in acl if v and v.strip()})
    if allowed:
        items = items.filter(F.trim("source_uid").isin(allowed) | F.concat(F.lit(f"{table}:"), F.col("id").cast("string")).isin(allowed))
    rows = items.select("id", F.coalesce("raw_text", F.lit("")).alias("x")).withColumn("y", X.redact(F.col("x")))
    return rows.select("id", F.sha2("y", 256).alias("snapshot"), F.when(F.col("x") != F.col("y"), "redacted").otherwise("plain").alias("state"))
