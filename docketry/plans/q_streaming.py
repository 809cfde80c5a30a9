"""Streams run to their end over the event table, with the same result as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.plans.book import Book, Tables
from docketry.runtime import checkpoint_dir
from docketry.streaming import events as E

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def _stream(t: Tables, parts: int) -> tuple[DataFrame, str]:
    """The events as files of a folder, in parts by id, and the folder's parent."""
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value", "ts")
    rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").write.parquet(f"{base}/in")
    return E.read_events(t.spark, f"{base}/in", rows.schema), base


@book.add("SELECT user_id AS run_id, count(*) AS events, count(*) AS last_seq, CAST(count(DISTINCT event_id) AS BIGINT) AS distinct_seq FROM events GROUP BY 1")
def x01_sequenced_stream(t: Tables) -> DataFrame:
    stream, base = _stream(t, 3)
    E.run_to_end(E.sequenced(stream), f"{base}/out", f"{base}/state")
    rows = t.spark.read.schema(E.SEQUENCED).parquet(f"{base}/out")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), F.countDistinct("seq").alias("distinct_seq"))


@book.add()
def x03_control_stream(t: Tables) -> DataFrame:
    stream, base = _stream(t, 2)
    E.run_to_end(E.controlled(stream), f"{base}/out", f"{base}/state")
    rows = t.spark.read.schema(E.CONTROL).parquet(f"{base}/out")
    return rows.groupBy("run_id").agg(F.sum("consumed").alias("consumed"), F.max("refinements").alias("most_open"), F.count_if(F.col("state") == "paused").alias("paused"))


@book.add("SELECT user_id AS run_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def x04_deduplicated_stream(t: Tables) -> DataFrame:
    stream, base = _stream(t, 2)
    E.run_to_end(E.deduplicated(stream, ["run_id", "event_type"]), f"{base}/out", f"{base}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out").groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x07_incremental_counts(t: Tables) -> DataFrame:
    stream, base = _stream(t, 3)

    def handle(batch: DataFrame, epoch: int) -> None:
        # one folder per batch: a batch that comes again replaces its own result
        batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    E.upkeep(stream, handle, f"{base}/state")
    parts = t.spark.read.schema("day date, event_type string, n bigint, epoch int").parquet(f"{base}/out")
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


@book.add("""WITH c AS (SELECT id, CAST(floor(epoch_us(updated_at) / 1000000) AS BIGINT) AS u FROM rag_chunks), m AS (SELECT CAST(floor(max(epoch_us(updated_at)) / 1000000) AS BIGINT) AS seen FROM rag_chunk_embeddings)
    SELECT c.id FROM c, m WHERE c.u > m.seen OR NOT EXISTS (SELECT 1 FROM rag_chunk_embeddings e WHERE e.chunk_id = c.id)""")
def x08_marker_redelivery(t: Tables) -> DataFrame:
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000000)
    made = t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), F.lit(1).alias("made"))
    seen = t.rag_chunk_embeddings.agg(F.max(second("updated_at")).alias("seen"))
    rows = t.rag_chunks.select("id", second("updated_at").alias("u")).join(made, "id", "left").join(F.broadcast(seen), F.lit(True))
    return rows.filter((F.col("u") > F.col("seen")) | F.col("made").isNull()).select("id")
