"""Queries over the operators of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import canonical, encoding, language, mixing, neardup, packing, splitting, tokens, vectors
from docketry.runtime import checkpoint, checkpoint_dir, table


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "canada_case_law_links")
    official = table(spark, sf_dir, "canada_laws").filter("origin = 'official'")
    linked = links.filter("law_id is not null").groupBy("law_id").agg(F.count(F.lit(1)).alias("n"))
    return canonical.map_to_reference(links.filter("law_id is null"), official, "id", "matched_alias", linked)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unresolved link with the official law its alias names, or -1."""
    return _mapped(spark, sf_dir).select(F.col("id").alias("link_id"), "law_id")


def p1_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that name no one official law: rows that have them, laws that fit, and of these the one nearest by cost and links."""
    links = table(spark, sf_dir, "canada_case_law_links")
    missed = _mapped(spark, sf_dir).filter("law_id = -1")
    return links.select("id", "matched_alias").join(missed.drop("law_id", "cost"), "id").groupBy("matched_alias").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_fit").alias("n_fit"), F.max("nearest").alias("nearest_law_id"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, sf_dir, "source_items"), "id", neardup.content())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nearly equal records, copies included."""
    members, pairs = _near(spark, sf_dir)
    return neardup.expand_pairs(members, pairs, "id").select("item_a", "item_b").distinct()


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal records with their similarity."""
    return _near(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every record that takes part."""
    return _near(spark, sf_dir)[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's 5 most similar, from a cosine of 0.70."""
    lists = vectors.most_similar(table(spark, sf_dir, "rag_chunk_embeddings"), "chunk_id", 5, 0.70)
    return vectors.pairs_found(lists, "chunk_id")


def p3_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every chunk, whatever their cosine."""
    return vectors.most_similar(table(spark, sf_dir, "rag_chunk_embeddings"), "chunk_id", 5)


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, chunks = table(spark, sf_dir, "source_items"), table(spark, sf_dir, "rag_chunks")
    out = None
    for name, rows, column in (("source_items", items, "title"), ("source_items", items, "raw_text"), ("rag_chunks", chunks, "title")):
        part = encoding.restore(rows, ["id"], column).select(F.lit(name).alias("tbl"), F.lit(column).alias("col"), F.col("id").alias("row_id"), "restored", "complete")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that hold wrongly decoded characters."""
    return _damaged(spark, sf_dir).select("tbl", "col", "row_id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged values with their text as far as it can be restored."""
    return _damaged(spark, sf_dir)


def _pieces(spark: SparkSession, sf_dir: str, pieces: bool = True) -> DataFrame:
    items = splitting.split_text(table(spark, sf_dir, "source_items"), ["id"], "raw_text", 6000, 200, pieces=pieces)
    chunks = splitting.split_text(table(spark, sf_dir, "rag_chunks"), ["id"], "text_content", 1800, 80, pieces=pieces)
    return items.withColumn("tbl", F.lit("source_items")).unionByName(chunks.withColumn("tbl", F.lit("rag_chunks"))).withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that are cut: those with a first piece."""
    return _pieces(spark, sf_dir, pieces=False).filter("chunk_index = 0").select("tbl", "row_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their numbers and offsets."""
    return _pieces(spark, sf_dir).select("tbl", "row_id", "chunk_index", "start", "length", "piece")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each cut item put together from its pieces, as a hash, and whether the pieces keep the limit and overlap."""
    most = F.when(F.col("tbl") == "source_items", 6000).otherwise(1800)
    over = F.when(F.col("tbl") == "source_items", 200).otherwise(80)
    parts = _pieces(spark, sf_dir).withColumn("n", F.length("piece")).withColumn("fits", (F.col("n") <= most) & (F.col("n") == F.col("length")))
    # the pieces of one item are together no longer than its own row
    items = parts.groupBy("tbl", "row_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "piece", "fits"))).alias("l")).withColumn("over", over)
    whole = F.aggregate("l", F.lit(""), lambda t, x: F.concat(t, F.when(x["chunk_index"] == 0, x["piece"]).otherwise(F.substring(x["piece"], F.col("over") + 1, F.length(x["piece"])))))
    told = F.expr("forall(sequence(1, size(l) - 1), i -> left(get(l, i).piece, over) = right(get(l, i - 1).piece, over) and get(l, i).chunk_index = i)")
    return items.select("tbl", "row_id", F.md5(whole).alias("text_hash"), F.expr("forall(l, x -> x.fits)").alias("within_limit"), told.alias("overlapping"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw texts written into files, a line each, and these cut by byte ranges: pieces, characters, longest piece."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "source_items").select(F.regexp_replace("raw_text", r"[\r\n]+", " ").alias("value")).filter("value is not null")
    texts.write.text(folder)
    paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect()]
    found = splitting.split_files(spark, [p.removeprefix("file:") for p in paths], 6000, 200, 1 << 20)
    ends = found.groupBy("path").agg(F.max(F.col("start") + F.col("length")).alias("n_chars"), F.max("length").alias("longest"), (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("whole"), (F.sum("length") - 200 * (F.count(F.lit(1)) - 1)).alias("n_summed"))
    return ends.agg(F.sum("n_chars").cast("bigint").alias("n_chars"), F.sum("n_summed").cast("bigint").alias("n_summed"), F.every(F.col("longest") <= 6000).alias("within_limit"), F.every("whole").alias("without_holes"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or part of one, for each profile."""
    sizes = checkpoint(tokens.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.pack(sizes, table(spark, sf_dir, "pack_limits"), "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile the containers used, the fewest possible by total size, and the filled share."""
    limits = table(spark, sf_dir, "pack_limits")
    per = p6_containers(spark, sf_dir).groupBy("profile", "container").agg(F.sum("n_tokens").alias("n")).groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return per.join(F.broadcast(limits), "profile").select("profile", "capacity_tokens", "containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest"), "fullest", F.round(F.col("n_tokens") / F.col("capacity_tokens") / F.col("containers"), 4).alias("filled"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile the documents packed, and whether each is there once and whole, no container is over its capacity, and few more are used than the fewest."""
    rows = checkpoint(p6_containers(spark, sf_dir))
    limits = table(spark, sf_dir, "pack_limits")
    docs = rows.groupBy("profile", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"), (F.max("part") + 1 == F.count(F.lit(1))).alias("whole"))
    docs = docs.join(F.broadcast(limits), "profile").groupBy("profile").agg(F.count(F.lit(1)).alias("n_docs"), F.every(F.col("whole") & (F.col("c") == F.ceil(F.col("n") / F.col("capacity_tokens")))).alias("once_and_whole"))
    boxes = rows.groupBy("profile", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(limits), "profile")
    boxes = boxes.groupBy("profile").agg(F.every(F.col("n") <= F.col("capacity_tokens")).alias("within_capacity"), (F.count(F.lit(1)) <= 1 + 1.02 * F.sum("n") / F.first("capacity_tokens")).alias("near_fewest"))
    return docs.join(boxes, "profile")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = checkpoint(tokens.token_sizes(table(spark, sf_dir, "documents").filter("source is not null"), "doc_id", "text", ("source",)))
    targets = table(spark, sf_dir, "mix_targets")
    return sizes, targets, mixing.mix(sizes, targets, "doc_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each appears."""
    return _mix(spark, sf_dir)[2]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mixing.mix_report(*_mix(spark, sf_dir))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target share of each source of each mix, and whether repeats and budget are kept, the latter to within a document."""
    sizes, targets, chosen = _mix(spark, sf_dir)
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken"), F.max("repeats").alias("most"), F.count_distinct("doc_id").alias("d"), F.count(F.lit(1)).alias("c"))
    rows = mixing.mix_plan(sizes, targets).join(got, ["mix_name", "source"], "left").join(largest, "source", "left").fillna(0, ["taken", "most", "d", "c", "largest"])
    return rows.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), "max_repeats", ((F.col("most") <= F.col("max_repeats")) & (F.col("d") == F.col("c"))).alias("within_repeats"), (F.abs(F.col("taken") - F.col("budget_tokens")) <= F.col("largest")).alias("within_budget"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages_of(docs, language.train(docs), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and all segments of mixed ones."""
    return _languages(spark, sf_dir).filter("seg_no >= 0 or declared <> lang").select("doc_id", "seg_no", "lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document and of the segments of mixed ones, with confidence."""
    return _languages(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))


QUERIES = {f.__name__: f for f in (p1_found, p1_misses, p2_found, p2_pairs, p2_members, p3_found, p3_lists, p4_found, p4_restored, p5_found, p5_pieces, p5_rebuilt, p5_files, p6_containers, p6_fill, p6_kept, p7_mix, p7_shares, p7_kept, p8_found, p8_languages)}

#: The distinct shingles of every record of 40 tokens or more.
_SHINGLES = r"""
        WITH w AS (
            SELECT id, list_filter(regexp_extract_all(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM source_items
        ), s AS (
            SELECT id, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM w WHERE len(t) >= 40
        )"""

#: All pairs of usable vectors of one model; cells miss nothing where there are no more of them than each row probes (to sf0.01).
_NEIGHBOURS = """
        WITH v AS (
            SELECT chunk_id, coalesce(embedding_model, '') AS m, embedding_vector::DOUBLE[] AS x FROM rag_chunk_embeddings
            WHERE len(embedding_vector) = dimension AND len(list_filter(embedding_vector, lambda e: e IS NULL OR isnan(e))) = 0
              AND len(list_filter(embedding_vector, lambda e: e <> 0)) > 0
        ), p AS (
            SELECT a.chunk_id, b.chunk_id AS neighbour, round(list_cosine_similarity(a.x, b.x), 6) AS cosine
            FROM v a JOIN v b ON a.m = b.m AND a.chunk_id <> b.chunk_id
        )"""

ORACLE = {
    "p5_found": """
        SELECT 'source_items' AS tbl, id AS row_id FROM source_items WHERE length(raw_text) > 6000
        UNION ALL SELECT 'rag_chunks', id FROM rag_chunks WHERE length(text_content) > 1800""",
    "p6_kept": r"""
        SELECT profile, (SELECT count(*) FROM documents WHERE regexp_matches(text, '[^\s\x{85}\x{A0}\x{2028}\x{3000}]')) AS n_docs, true AS once_and_whole, true AS within_capacity, true AS near_fewest FROM pack_limits""",
    "p7_kept": """
        SELECT mix_name, source, round(target_weight / sum(target_weight) OVER (PARTITION BY mix_name), 6) AS target_share, max_repeats, true AS within_repeats, true AS within_budget
        FROM mix_targets WHERE target_weight > 0 AND max_repeats > 0""",
    "p5_rebuilt": """
        SELECT 'source_items' AS tbl, id AS row_id, md5(raw_text) AS text_hash, true AS within_limit, true AS overlapping FROM source_items WHERE length(raw_text) > 6000
        UNION ALL SELECT 'rag_chunks', id, md5(text_content), true, true FROM rag_chunks WHERE length(text_content) > 1800""",
    "p5_files": """
        SELECT CAST(sum(length(regexp_replace(raw_text, '[\\r\\n]+', ' ', 'g')) + 1) AS BIGINT) AS n_chars, CAST(sum(length(regexp_replace(raw_text, '[\\r\\n]+', ' ', 'g')) + 1) AS BIGINT) AS n_summed,
            true AS within_limit, true AS without_holes
        FROM source_items WHERE raw_text IS NOT NULL""",
    "p2_found": _SHINGLES
    + """, e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM s),
        c AS (
            SELECT a.id AS item_a, b.id AS item_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
            FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id
        ) SELECT item_a, item_b FROM c WHERE k >= 0.5 * (na + nb - k)""",
    "p2_members": _SHINGLES + " SELECT id, min(id) OVER (PARTITION BY list_sort(g)) AS class_id FROM s",
    "p2_pairs": _SHINGLES
    + """, r AS (SELECT min(id) AS id, list_sort(g) AS g FROM s GROUP BY list_sort(g)), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM r),
        c AS (
            SELECT a.id AS class_a, b.id AS class_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
            FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id
        ) SELECT class_a, class_b, round(k / (na + nb - k), 6) AS similarity FROM c WHERE k >= 0.5 * (na + nb - k)""",
    "p3_lists": _NEIGHBOURS
    + """
        SELECT chunk_id, neighbour, cosine, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY cosine DESC, neighbour) AS INT) AS rank
        FROM p QUALIFY rank <= 5""",
    "p3_found": _NEIGHBOURS
    + """, k AS (
            SELECT chunk_id, neighbour, cosine FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY cosine DESC, neighbour) <= 5
        ) SELECT DISTINCT least(chunk_id, neighbour) AS chunk_a, greatest(chunk_id, neighbour) AS chunk_b FROM k WHERE cosine >= 0.70""",
}
