"""Files read and written: CSV with a byte-order mark and a sentinel, archives, ordered exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, nothing: str | None = None) -> DataFrame:
    """CSV files with a header; quoted fields may hold line breaks.

    A byte-order mark before the first name is dropped, names are trimmed, and
    fields that are ``nothing`` become ''. Columns are strings without a schema.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if nothing is None:
        return rows
    strings = [c for c, kind in rows.dtypes if kind == "string"]
    return rows.withColumns({c: F.when(F.trim(c) == nothing, "").otherwise(F.col(c)) for c in strings})


def write_ordered(rows: DataFrame, key: str, folder: str) -> None:
    """JSON lines in order of ``key`` within each file and, by their names, over all files: each holds a range of keys."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.json(folder)


def write_archive(items: DataFrame, key: str, folder: str) -> None:
    """An archive of items, a JSON line each, in folders by the first hex digit of the key's hash."""
    items.withColumn("shard", F.substring(F.md5(F.col(key).cast("string")), 1, 1)).write.partitionBy("shard").json(folder)


def read_archive(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The items of an archive, whatever folders below ``folder`` they are in."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)
