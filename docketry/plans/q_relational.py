"""Joins, aggregates, windows, ordering and set operations over the document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators import relational as R
from docketry.plans.book import Book, Tables

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

KIND_SQL = "CASE WHEN source_table = 'canada_laws' THEN 'law' ELSE 'case' END"
CODE_SQL = "coalesce(nullif(trim(lower(source_code)), ''), 'unknown')"


def kind() -> Column:
    return F.when(F.col("source_table") == "canada_laws", "law").otherwise("case")


def code() -> Column:
    return F.coalesce(F.nullif(F.trim(F.lower("source_code")), F.lit("")), F.lit("unknown"))


def official(t: Tables) -> DataFrame:
    return t.canada_laws.filter("origin = 'official'")


@book.add(f"SELECT {CODE_SQL} AS source_code, count(*) AS n FROM source_items GROUP BY 1")
def a01_source_counts(t: Tables) -> DataFrame:
    return t.source_items.groupBy(code().alias("source_code")).agg(F.count(F.lit(1)).alias("n"))


@book.add(f"SELECT {KIND_SQL} AS kind, count(*) AS chunks, count(DISTINCT source_table || ':' || source_id) AS documents FROM rag_chunks GROUP BY 1")
def a02_kind_documents(t: Tables) -> DataFrame:
    return t.rag_chunks.groupBy(kind().alias("kind")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_table", "source_id").alias("documents"))


@book.add("SELECT count(*) AS n, count(DISTINCT lower(trim(title))) AS titles FROM source_items WHERE trim(title) <> ''")
def a03_distinct_titles(t: Tables) -> DataFrame:
    return t.source_items.filter(F.trim("title") != "").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower(F.trim("title"))).alias("titles"))


@book.add("SELECT count(*) AS total, count(*) FILTER (WHERE law_id IS NULL) AS unresolved, count(*) FILTER (WHERE match_score >= 0.9) AS sure FROM canada_case_law_links")
def a04_filtered_counts(t: Tables) -> DataFrame:
    return t.canada_case_law_links.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("law_id").isNull()).alias("unresolved"), F.count_if(F.col("match_score") >= 0.9).alias("sure"))


@book.add("SELECT source, coalesce(string_agg(DISTINCT lower(lang), ',' ORDER BY lower(lang)), '') AS langs FROM documents GROUP BY source")
def a05_distinct_tags(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.lower("lang"))), ",").alias("langs"))


@book.add("""SELECT l.id AS law_id, l.title, count(DISTINCT k.case_item_id) AS cases FROM canada_laws l LEFT JOIN canada_case_law_links k ON k.law_id = l.id
    WHERE l.origin = 'official' GROUP BY 1, 2 ORDER BY cases DESC, law_id LIMIT 100""")
def a06_cases_per_law(t: Tables) -> DataFrame:
    counts = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id").agg(F.countDistinct("case_item_id").alias("n"))
    laws = official(t).select(F.col("id").alias("law_id"), "title")
    return laws.join(counts, "law_id", "left").select("law_id", "title", F.coalesce("n", F.lit(0)).cast("bigint").alias("cases")).orderBy(F.desc("cases"), "law_id").limit(100)


@book.add("SELECT coalesce(embedding_provider, '') AS provider, embedding_model AS model, dimension, count(*) AS n FROM rag_chunk_embeddings GROUP BY 1, 2, 3")
def a07_vector_groups(t: Tables) -> DataFrame:
    return t.rag_chunk_embeddings.groupBy(F.coalesce("embedding_provider", F.lit("")).alias("provider"), F.col("embedding_model").alias("model"), "dimension").agg(F.count(F.lit(1)).alias("n"))


ALIASES = [("a2aj_case", "case"), ("canlii", "case"), ("url_canada_case", "case"), ("manual_canada_case", "case"), ("on_statute", "law"), ("ca_federal_act", "law"), ("ca_federal_regulation", "law")]


@book.add("""SELECT coalesce(a.canonical, 'raw:' || c.alias) AS canonical, CAST(sum(c.n) AS BIGINT) AS n FROM (
    SELECT coalesce(source, 'unknown') AS alias, count(*) AS n FROM documents GROUP BY 1) c
    LEFT JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") a(alias, canonical) ON a.alias = c.alias GROUP BY 1")
def a08_alias_merged_facets(t: Tables) -> DataFrame:
    names = F.broadcast(t.spark.createDataFrame(ALIASES, "alias string, canonical string"))
    return R.alias_merged_counts(t.documents, F.coalesce("source", F.lit("unknown")), names)


@book.add("SELECT CAST(year(published_at) AS INT) AS year, count(*) AS n FROM rag_chunks WHERE published_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def a09_year_facets(t: Tables) -> DataFrame:
    return t.rag_chunks.filter("published_at is not null").groupBy(F.year("published_at").alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year")).limit(10)


@book.add("""SELECT (SELECT count(*) FROM source_items) AS items, (SELECT max(id) FROM source_items) AS last_item, (SELECT count(*) FROM canada_laws WHERE origin = 'official') AS laws,
    (SELECT count(*) FROM canada_case_law_links) AS links, (SELECT max(epoch_us(updated_at)) FROM canada_case_law_links) AS links_updated""")
def a10_source_signature(t: Tables) -> DataFrame:
    items = t.source_items.agg(F.count(F.lit(1)).alias("items"), F.max("id").alias("last_item"))
    laws = official(t).agg(F.count(F.lit(1)).alias("laws"))
    links = t.canada_case_law_links.agg(F.count(F.lit(1)).alias("links"), F.unix_micros(F.max(F.col("updated_at").cast("timestamp"))).alias("links_updated"))
    # each side is an aggregate of one row
    return items.join(F.broadcast(laws), F.lit(True)).join(F.broadcast(links), F.lit(True))


@book.add("""SELECT o.o_orderkey AS case_id, coalesce(v.up, 0) AS up, coalesce(v.down, 0) AS down, coalesce(v.up, 0) - coalesce(v.down, 0) AS score FROM orders o LEFT JOIN (
    SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS down
    FROM lineitem GROUP BY 1) v ON v.l_orderkey = o.o_orderkey""")
def a11_vote_pivot(t: Tables) -> DataFrame:
    votes = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("up"), F.count_if(F.col("l_returnflag") == "R").alias("down"))
    rows = t.orders.select(F.col("o_orderkey").alias("case_id")).join(votes, "case_id", "left").fillna(0, ["up", "down"])
    return rows.withColumn("score", F.col("up") - F.col("down"))


@book.add("SELECT law_id, count(*) AS links FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1 ORDER BY links DESC, law_id LIMIT 10")
def a12_top_laws(t: Tables) -> DataFrame:
    return t.canada_case_law_links.filter("law_id is not null").groupBy("law_id").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "law_id").limit(10)


@book.add("""SELECT CASE WHEN source IN ('a2aj_case', 'canlii', 'url_canada_case', 'manual_canada_case') THEN 'case' WHEN source IS NULL THEN 'unknown' WHEN source LIKE '%statute%' OR source LIKE '%act%' OR source LIKE '%regulation%' THEN 'law' ELSE 'other' END AS bucket,
    count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def a13_bucket_counts(t: Tables) -> DataFrame:
    s = F.col("source")
    bucket = F.when(s.isin("a2aj_case", "canlii", "url_canada_case", "manual_canada_case"), "case").when(s.isNull(), "unknown").when(s.contains("statute") | s.contains("act") | s.contains("regulation"), "law").otherwise("other")
    return t.documents.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("bigint").alias("chars"))


@book.add("SELECT source_kind, max(id) AS last_id, CAST(floor(max(epoch_us(updated_at)) / 1000000) AS BIGINT) AS marker FROM rag_chunks GROUP BY 1")
def a14_cursor_marker(t: Tables) -> DataFrame:
    return t.rag_chunks.groupBy("source_kind").agg(F.max("id").alias("last_id"), F.floor(F.unix_micros(F.max(F.col("updated_at").cast("timestamp"))) / 1000000).cast("bigint").alias("marker"))


MENTION = r"([A-Z][a-z]+(?: [A-Z][a-z]+){0,4} (?:Act|Regulations|Rules))"


@book.add(rf"""WITH m AS (SELECT id, unnest(regexp_extract_all(coalesce(evidence_excerpt, ''), '{MENTION}', 1)) AS title FROM canada_case_law_links)
    SELECT lower(title) AS mention, count(*) AS mentions, arg_min(title, (id, title)) AS sample FROM m GROUP BY 1""")
def a15_mention_counts(t: Tables) -> DataFrame:
    found = t.canada_case_law_links.select("id", F.explode(F.regexp_extract_all(F.coalesce("evidence_excerpt", F.lit("")), F.lit(MENTION), F.lit(1))).alias("title"))
    return found.groupBy(F.lower("title").alias("mention")).agg(F.count(F.lit(1)).alias("mentions"), F.min_by("title", F.struct("id", "title")).alias("sample"))


@book.add("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM p)
    SELECT a.user_id, a.events, a.spent, a.mean_value, r.top FROM (SELECT user_id, count(*) AS events, round(sum(greatest(coalesce(value, 0), 0)), 4) AS spent, round(avg(value), 4) AS mean_value FROM events GROUP BY 1) a
    JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1) r ON r.user_id = a.user_id""")
def a16_preference_rollup(t: Tables) -> DataFrame:
    sums = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))), 4).alias("spent"), F.round(F.avg("value"), 4).alias("mean_value"))
    types = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = R.first_per_group(types, ["user_id"], [F.desc("n"), "event_type"], 3, "k").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]), ",").alias("top"))
    return sums.join(top, "user_id")


@book.add("""SELECT doc_id, CAST(row_number() OVER w AS INT) AS keeper_rank, CAST(sum(coalesce(n_chars, 0)) OVER g AS BIGINT) AS sum_chars, min(doc_id) OVER g AS min_doc_id, row_number() OVER w > 1 AS is_duplicate
    FROM documents WHERE text IS NOT NULL WINDOW g AS (PARTITION BY sha256(text)), w AS (PARTITION BY sha256(text) ORDER BY coalesce(n_chars, 0) DESC, doc_id)""")
def a17_duplicate_merge(t: Tables) -> DataFrame:
    rows = t.documents.filter("text is not null").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("chars"), F.sha2("text", 256).alias("h"))
    out = R.merge_duplicates(rows, ["h"], [F.desc("chars"), F.col("doc_id")], sums=["chars"], least=["doc_id"])
    return out.select("doc_id", "keeper_rank", "sum_chars", "min_doc_id", "is_duplicate")


@book.add("""SELECT c.source_kind, count(*) AS total, count(*) FILTER (WHERE e.chunk_id IS NULL) AS pending, round(100.0 * count(e.chunk_id) / count(*), 4) AS percent
    FROM rag_chunks c LEFT JOIN rag_chunk_embeddings e ON e.chunk_id = c.id GROUP BY 1""")
def a18_embedding_progress(t: Tables) -> DataFrame:
    rows = t.rag_chunks.select("id", "source_kind").join(t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), F.lit(1).alias("made")), "id", "left")
    return rows.groupBy("source_kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("made").isNull()).alias("pending"), F.round(100.0 * F.count("made") / F.count(F.lit(1)), 4).alias("percent"))


@book.add("SELECT event_type, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, count(*) AS n FROM events GROUP BY 1")
def a19_trial_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"), F.count(F.lit(1)).alias("n"))


@book.add("""SELECT event_type, """ + ", ".join(f"list_sort(list(value))[CAST(least(floor(count(*) * {p}), count(*) - 1) AS INT) + 1] AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events WHERE value IS NOT NULL GROUP BY 1")
def a20_floor_percentiles(t: Tables) -> DataFrame:
    return R.floor_percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@book.add("SELECT e.embedding_model, count(*) AS stale FROM rag_chunks c JOIN rag_chunk_embeddings e ON e.chunk_id = c.id WHERE c.content_hash <> e.content_hash GROUP BY 1")
def a22_stale_vectors(t: Tables) -> DataFrame:
    made = t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), "embedding_model", F.col("content_hash").alias("made_of"))
    return t.rag_chunks.select("id", "content_hash").join(made, "id").filter("content_hash <> made_of").groupBy("embedding_model").agg(F.count(F.lit(1)).alias("stale"))


@book.add("""WITH g AS (SELECT jurisdiction, count(*) AS n, avg(CASE WHEN coalesce(trim(citation), '') <> '' THEN 1.0 ELSE 0.0 END) AS traceable, avg(CASE WHEN authority_status = 'current' THEN 1.0 ELSE 0.0 END) AS current_share,
    avg(CASE WHEN token_count > 0 THEN 1.0 ELSE 0.0 END) AS complete FROM rag_chunks GROUP BY 1)
    SELECT jurisdiction, n, round(traceable, 4) AS traceable, round(current_share, 4) AS current_share, round(complete, 4) AS complete,
    CASE WHEN traceable < 0.7 THEN 'traceability' WHEN current_share < 0.8 THEN 'currency' WHEN complete < 0.6 THEN 'completeness' ELSE 'passed' END AS verdict FROM g""")
def a24_quality_gate(t: Tables) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = t.rag_chunks.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"), share(F.trim(F.coalesce("citation", F.lit(""))) != "").alias("a"), share(F.col("authority_status") == "current").alias("b"), share(F.col("token_count") > 0).alias("c"))
    verdict = F.when(F.col("a") < 0.7, "traceability").when(F.col("b") < 0.8, "currency").when(F.col("c") < 0.6, "completeness").otherwise("passed")
    return g.select("jurisdiction", "n", F.round("a", 4).alias("traceable"), F.round("b", 4).alias("current_share"), F.round("c", 4).alias("complete"), verdict.alias("verdict"))


@book.add("""WITH s AS (SELECT (SELECT count(*) FROM source_items) AS cases, (SELECT count(*) FROM source_items WHERE length(raw_text) >= 3000) AS texts, (SELECT count(*) FROM canada_case_law_links) AS links,
    (SELECT count(*) FROM canada_case_law_links WHERE law_id IS NOT NULL) AS matched)
    SELECT *, array_to_string(list_filter([CASE WHEN cases < 1000 THEN 'cases' END, CASE WHEN texts < 50 THEN 'full_texts' END, CASE WHEN links < 500 THEN 'links' END, CASE WHEN matched = 0 THEN 'matched_laws' END], lambda x: x IS NOT NULL), ',') AS missing FROM s""")
def a25_data_readiness(t: Tables) -> DataFrame:
    s = t.source_items.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.length("raw_text") >= 3000).alias("texts"))
    k = t.canada_case_law_links.agg(F.count(F.lit(1)).alias("links"), F.count("law_id").alias("matched"))
    gaps = F.array(F.when(F.col("cases") < 1000, "cases"), F.when(F.col("texts") < 50, "full_texts"), F.when(F.col("links") < 500, "links"), F.when(F.col("matched") == 0, "matched_laws"))
    return s.join(F.broadcast(k), F.lit(True)).withColumn("missing", F.array_join(F.array_compact(gaps), ","))


@book.add(f"""SELECT count(*) AS total, count(*) FILTER (WHERE {CODE_SQL} IN ('a2aj_case', 'canlii', 'url_canada_case')) AS cases, count(*) FILTER (WHERE {CODE_SQL} LIKE '%act%' OR {CODE_SQL} LIKE '%statute%') AS laws,
    count(*) FILTER (WHERE {CODE_SQL} = 'unknown') AS unknown FROM source_items""")
def a28_source_breakdown(t: Tables) -> DataFrame:
    return t.source_items.agg(F.count(F.lit(1)).alias("total"), F.count_if(code().isin("a2aj_case", "canlii", "url_canada_case")).alias("cases"), F.count_if(code().contains("act") | code().contains("statute")).alias("laws"), F.count_if(code() == "unknown").alias("unknown"))


@book.add("""SELECT k.id, s.title AS case_title, l.title AS law_title, round(k.match_score, 4) AS score FROM canada_case_law_links k JOIN source_items s ON s.id = k.case_item_id JOIN canada_laws l ON l.id = k.law_id
    WHERE l.origin = 'official' AND k.match_score >= 0.5 ORDER BY k.match_score DESC NULLS LAST, k.id LIMIT 200""")
def j01_fact_two_dimensions(t: Tables) -> DataFrame:
    laws = official(t).select(F.col("id").alias("law_id"), F.col("title").alias("law_title"))
    items = t.source_items.select(F.col("id").alias("case_item_id"), F.col("title").alias("case_title"))
    rows = t.canada_case_law_links.filter("match_score >= 0.5 and law_id is not null").select("id", "case_item_id", "law_id", "match_score").join(laws, "law_id").join(items, "case_item_id")
    return rows.orderBy(F.desc_nulls_last("match_score"), "id").limit(200).select("id", "case_title", "law_title", F.round("match_score", 4).alias("score"))


@book.add("""SELECT c.id AS chunk_id, k.id AS link_id, l.slug, e.embedding_model FROM canada_case_law_links k JOIN source_items s ON s.id = k.case_item_id JOIN canada_laws l ON l.id = k.law_id
    JOIN rag_chunks c ON c.source_table = 'source_items' AND c.source_id = s.id JOIN rag_chunk_embeddings e ON e.chunk_id = c.id""")
def j02_id_space_translation(t: Tables) -> DataFrame:
    links = t.canada_case_law_links.filter("law_id is not null").select(F.col("id").alias("link_id"), F.col("case_item_id").alias("source_id"), "law_id")
    laws = t.canada_laws.select(F.col("id").alias("law_id"), "slug")
    items = t.source_items.select(F.col("id").alias("source_id"))
    chunks = t.rag_chunks.filter("source_table = 'source_items'").select(F.col("id").alias("chunk_id"), "source_id")
    made = t.rag_chunk_embeddings.select("chunk_id", "embedding_model")
    return links.join(laws, "law_id").join(items, "source_id").join(chunks, "source_id").join(made, "chunk_id").select("chunk_id", "link_id", "slug", "embedding_model")


@book.add("SELECT s.id, count(c.id) AS chunks, CAST(coalesce(sum(c.token_count), 0) AS BIGINT) AS tokens FROM source_items s LEFT JOIN rag_chunks c ON c.source_table = 'source_items' AND c.source_id = s.id GROUP BY 1")
def j03_left_outer_group(t: Tables) -> DataFrame:
    per = t.rag_chunks.filter("source_table = 'source_items'").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    return t.source_items.select("id").join(per, "id", "left").fillna(0, ["chunks", "tokens"])


@book.add("""SELECT c.id, CASE WHEN e.chunk_id IS NULL THEN 'missing' WHEN c.content_hash <> e.content_hash THEN 'hash' ELSE 'model' END AS reason FROM rag_chunks c LEFT JOIN rag_chunk_embeddings e ON e.chunk_id = c.id
    WHERE e.chunk_id IS NULL OR c.content_hash <> e.content_hash OR e.embedding_model <> 'lexvec-base'""")
def j04_missing_or_stale(t: Tables) -> DataFrame:
    made = t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("_hash"), F.col("embedding_model").alias("_model"), F.lit(1).alias("_made"))
    stale = (F.col("content_hash") != F.col("_hash")) | (F.col("_model") != "lexvec-base")
    rows = R.missing_or_stale(t.rag_chunks.select("id", "content_hash"), made, "id", stale)
    return rows.select("id", F.when(F.col("_made").isNull(), "missing").when(F.col("content_hash") != F.col("_hash"), "hash").otherwise("model").alias("reason"))


@book.add("SELECT s.id FROM source_items s WHERE NOT EXISTS (SELECT 1 FROM rag_chunks c WHERE c.source_table = 'source_items' AND c.source_id = s.id)")
def j05_unchunked_sources(t: Tables) -> DataFrame:
    return t.source_items.select("id").join(t.rag_chunks.filter("source_table = 'source_items'").select(F.col("source_id").alias("id")), "id", "left_anti")


@book.add("SELECT s.id, s.source_uid FROM source_items s WHERE EXISTS (SELECT 1 FROM canada_case_law_links k WHERE k.case_item_id = s.id AND k.match_score > 0.8)")
def j06_semi_join(t: Tables) -> DataFrame:
    return t.source_items.select("id", "source_uid").join(t.canada_case_law_links.filter("match_score > 0.8").select(F.col("case_item_id").alias("id")), "id", "left_semi")


@book.add("SELECT c.jurisdiction, count(*) AS pending FROM rag_chunks c LEFT JOIN rag_chunk_embeddings e ON e.chunk_id = c.id AND e.embedding_model = 'lexvec-base' AND e.embedding_provider = 'local' WHERE e.chunk_id IS NULL GROUP BY 1")
def j07_pending_for_model(t: Tables) -> DataFrame:
    made = t.rag_chunk_embeddings.filter("embedding_model = 'lexvec-base' and embedding_provider = 'local'").select(F.col("chunk_id").alias("id"))
    return t.rag_chunks.select("id", "jurisdiction").join(made, "id", "left_anti").groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("pending"))


@book.add("""SELECT k.id, (SELECT c.id FROM rag_chunks c WHERE c.source_table = 'source_items' AND c.source_id = k.case_item_id ORDER BY c.chunk_index, c.id LIMIT 1) AS case_chunk,
    (SELECT c.id FROM rag_chunks c WHERE c.source_table = 'canada_laws' AND c.source_id = k.law_id ORDER BY c.chunk_index, c.id LIMIT 1) AS law_chunk FROM canada_case_law_links k WHERE k.law_id IS NOT NULL""")
def j08_first_chunk_lookup(t: Tables) -> DataFrame:
    first = R.first_per_group(t.rag_chunks.select("id", "source_table", "source_id", "chunk_index"), ["source_table", "source_id"], ["chunk_index", "id"])
    cases = first.filter("source_table = 'source_items'").select(F.col("source_id").alias("case_item_id"), F.col("id").alias("case_chunk"))
    laws = first.filter("source_table = 'canada_laws'").select(F.col("source_id").alias("law_id"), F.col("id").alias("law_chunk"))
    return t.canada_case_law_links.filter("law_id is not null").select("id", "case_item_id", "law_id").join(cases, "case_item_id", "left").join(laws, "law_id", "left").select("id", "case_chunk", "law_chunk")


@book.add("""WITH s AS (SELECT * FROM rag_chunks WHERE chunk_index > 0 AND token_count > 250)
    SELECT s.id AS seed_id, c.id, CAST(c.chunk_index - s.chunk_index AS INT) AS distance FROM s JOIN rag_chunks c ON c.source_table = s.source_table AND c.source_id = s.source_id AND c.chunk_index BETWEEN s.chunk_index - 1 AND s.chunk_index + 1""")
def j10_neighbour_window(t: Tables) -> DataFrame:
    c = t.rag_chunks.select("id", "source_table", "source_id", "chunk_index", "token_count")
    seeds = c.filter("chunk_index > 0 and token_count > 250").select(F.col("id").alias("seed_id"), "source_table", "source_id", "chunk_index")
    return R.neighbour_window(seeds, c.drop("token_count"), ["source_table", "source_id"], "chunk_index", 1).select("seed_id", "id", "distance")


@book.add("""WITH u AS (SELECT user_id, list_distinct(list(event_type || ':' || CAST(hour(ts) // 6 AS VARCHAR))) AS g FROM events GROUP BY 1)
    SELECT a.user_id AS user_a, b.user_id AS user_b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM u a JOIN u b ON a.user_id < b.user_id
    WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.28""")
def j11_pairwise_similarity(t: Tables) -> DataFrame:
    # only distinct sets of features are compared; a missing type or time makes no feature
    f = t.events.select("user_id", F.concat("event_type", F.lit(":"), F.floor(F.hour("ts") / 6).cast("string")).alias("g"))
    return R.similar_keys(f, "user_id", "g", 0.28, 6).select(F.col("a").alias("user_a"), F.col("b").alias("user_b"), "similarity")


@book.add("""WITH n AS (SELECT id, lower(trim(title)) AS t FROM canada_laws WHERE origin = 'official'), v AS (SELECT DISTINCT lower(trim(matched_alias)) AS t FROM canada_case_law_links WHERE trim(matched_alias) <> '')
    SELECT v.t AS value, min(n.id) AS law_id FROM v JOIN n ON n.t = v.t GROUP BY 1""")
def j13_exact_lookup(t: Tables) -> DataFrame:
    names = official(t).select(F.lower(F.trim("title")).alias("value"), F.col("id").alias("law_id"))
    values = t.canada_case_law_links.select(F.lower(F.trim("matched_alias")).alias("value")).filter("value <> ''").distinct()
    return values.join(names, "value").groupBy("value").agg(F.min("law_id").alias("law_id"))


@book.add("""SELECT id, max(hit) AS matched_by FROM (SELECT s.id, 'uid' AS hit FROM source_items s JOIN rag_chunks c ON c.source_uid = s.source_uid WHERE c.source_table = 'source_items'
    UNION SELECT s.id, 'id' FROM source_items s JOIN rag_chunks c ON c.source_table = 'source_items' AND c.source_id = s.id
    UNION SELECT s.id, 'url' FROM source_items s JOIN rag_chunks c ON c.source_url = s.item_url WHERE c.source_table = 'source_items') GROUP BY 1""")
def j14_three_key_match(t: Tables) -> DataFrame:
    s, c = t.source_items, t.rag_chunks.filter("source_table = 'source_items'")
    by = lambda left, right, name: s.select("id", F.col(left).alias("k")).join(c.select(F.col(right).alias("k")).distinct(), "k", "left_semi").select("id", F.lit(name).alias("hit"))
    return by("source_uid", "source_uid", "uid").unionByName(by("id", "source_id", "id")).unionByName(by("item_url", "source_url", "url")).groupBy("id").agg(F.max("hit").alias("matched_by"))


@book.add("""WITH e AS (SELECT o_custkey AS a, o_orderpriority AS b, max(o_totalprice) AS w FROM orders GROUP BY 1, 2), u AS (SELECT CAST(a AS VARCHAR) AS x, b AS y, w FROM e UNION ALL SELECT b, CAST(a AS VARCHAR), w FROM e)
    SELECT x AS node, count(*) AS degree, round(max(w), 2) AS strongest FROM u GROUP BY 1""")
def j15_undirected_edges(t: Tables) -> DataFrame:
    e = t.orders.groupBy(F.col("o_custkey").cast("string").alias("x"), F.col("o_orderpriority").alias("y")).agg(F.max("o_totalprice").alias("w"))
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    return both.groupBy(F.col("x").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.max("w"), 2).alias("strongest"))


@book.add("""SELECT case_item_id, arg_max(law_id, (updated_at, id)) AS law_id, count(*) AS runs FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1""")
def j17_newest_wins(t: Tables) -> DataFrame:
    return t.canada_case_law_links.filter("law_id is not null").groupBy("case_item_id").agg(F.max_by("law_id", F.struct("updated_at", "id")).alias("law_id"), F.count(F.lit(1)).alias("runs"))


@book.add("""SELECT k.law_id, l.title, round(max(k.match_score), 4) AS score FROM canada_case_law_links k JOIN canada_laws l ON l.id = k.law_id GROUP BY 1, 2 ORDER BY score DESC, law_id LIMIT 48""")
def j18_neighbour_laws(t: Tables) -> DataFrame:
    best = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id").agg(F.round(F.max("match_score"), 4).alias("score"))
    return best.join(t.canada_laws.select(F.col("id").alias("law_id"), "title"), "law_id").orderBy(F.desc("score"), "law_id").limit(48).select("law_id", "title", "score")


@book.add("SELECT o.o_orderkey, coalesce(c.c_name, 'deleted') AS shown FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def j19_optional_names(t: Tables) -> DataFrame:
    names = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("deleted")).alias("shown"))


@book.add("SELECT DISTINCT ON (source_table, source_id) source_table, source_id, id, chunk_index FROM rag_chunks ORDER BY source_table, source_id, chunk_index, id")
def w01_first_chunk(t: Tables) -> DataFrame:
    return R.first_per_group(t.rag_chunks.select("source_table", "source_id", "id", "chunk_index"), ["source_table", "source_id"], ["chunk_index", "id"])


@book.add("""SELECT source_code, source_uid, id FROM source_items WHERE source_code IS NOT NULL AND source_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_code, source_uid ORDER BY length(coalesce(raw_text, '')) DESC, id) = 1""")
def w02_best_per_key(t: Tables) -> DataFrame:
    rows = t.source_items.filter("source_code is not null and source_uid is not null").select("source_code", "source_uid", "id", F.length(F.coalesce("raw_text", F.lit(""))).alias("n"))
    return R.first_per_group(rows, ["source_code", "source_uid"], [F.desc("n"), "id"]).drop("n")


@book.add(f"""WITH k AS (SELECT id, published_at, coalesce('url:' || nullif(rtrim(lower(trim(item_url)), '/'), ''), 'source:' || source_code || ':' || source_uid, 'table:' || id) AS key FROM source_items)
    SELECT key, id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY published_at DESC NULLS LAST, id) = 1 ORDER BY published_at DESC NULLS LAST, id LIMIT 30""")
def w03_first_seen(t: Tables) -> DataFrame:
    url = F.nullif(F.regexp_replace(F.lower(F.trim("item_url")), "/+$", ""), F.lit(""))
    key = F.coalesce(F.concat(F.lit("url:"), url), F.concat(F.lit("source:"), "source_code", F.lit(":"), "source_uid"), F.concat(F.lit("table:"), F.col("id").cast("string")))
    rows = t.source_items.select("id", "published_at", key.alias("key"))
    return R.first_per_group(rows, ["key"], [F.desc_nulls_last("published_at"), "id"]).orderBy(F.desc_nulls_last("published_at"), "id").limit(30).select("key", "id")


@book.add("SELECT id, law_id, CAST(row_number() OVER (PARTITION BY law_id ORDER BY match_score DESC NULLS LAST, id) AS INT) AS rank FROM canada_case_law_links WHERE law_id IS NOT NULL")
def w04_rank_map(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.filter("law_id is not null").select("id", "law_id", "match_score")
    return R.first_per_group(rows, ["law_id"], [F.desc_nulls_last("match_score"), "id"], 1 << 30, "rank").drop("match_score")


@book.add(f"""SELECT id, {KIND_SQL} AS kind, round(token_count / greatest(1.0, max(token_count) OVER (PARTITION BY {KIND_SQL})), 6) AS normalised FROM rag_chunks WHERE token_count IS NOT NULL""")
def w05_kind_normalised(t: Tables) -> DataFrame:
    rows = t.rag_chunks.filter("token_count is not null").select("id", kind().alias("kind"), "token_count")
    top = rows.groupBy("kind").agg(F.max("token_count").alias("top"))
    # the maximum per kind is an aggregate of a few rows; a window would sort each kind in one task
    return rows.join(F.broadcast(top), "kind").select("id", "kind", F.round(F.col("token_count") / F.greatest(F.lit(1.0), F.col("top").cast("double")), 6).alias("normalised"))


@book.add("SELECT case_item_id, id, CAST(row_number() OVER (PARTITION BY case_item_id ORDER BY match_score DESC NULLS LAST, id) AS INT) AS rank FROM canada_case_law_links QUALIFY rank <= 4")
def w06_top_per_group(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.select("case_item_id", "id", "match_score")
    return R.first_per_group(rows, ["case_item_id"], [F.desc_nulls_last("match_score"), "id"], 4, "rank").drop("match_score")


@book.add("SELECT case_item_id, round(max(match_score), 6) AS score FROM canada_case_law_links WHERE match_score IS NOT NULL GROUP BY 1 ORDER BY max(match_score) DESC, 1 LIMIT 30")
def w07_merged_evidence(t: Tables) -> DataFrame:
    best = t.canada_case_law_links.filter("match_score is not null").groupBy("case_item_id").agg(F.max("match_score").alias("m"))
    return best.orderBy(F.desc("m"), "case_item_id").limit(30).select("case_item_id", F.round("m", 6).alias("score"))


@book.add("SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('error', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w08_latest_task(t: Tables) -> DataFrame:
    rows = t.events.filter(F.col("event_type").isin("error", "purchase")).select("user_id", "event_type", "event_id", "ts")
    return R.first_per_group(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@book.add("""WITH o AS (SELECT id, case_item_id, -match_score AS s FROM canada_case_law_links WHERE match_score IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY case_item_id ORDER BY s, id) = 1 AS first FROM o),
    r AS (SELECT *, sum(first::INT) OVER (ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS seen FROM f), e AS (SELECT *, sum((first AND seen = 12)::INT) OVER (ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM r)
    SELECT id, case_item_id FROM e WHERE coalesce(past, 0) = 0""")
def w09_running_distinct_cap(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.filter("match_score is not null").select("id", "case_item_id", F.negative("match_score").alias("s"))
    return R.running_distinct_cap(rows, "case_item_id", ["s", "id"], 12).select("id", "case_item_id")


@book.add("SELECT id, title FROM source_items ORDER BY published_at DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 50")
def t01_top_nulls_last(t: Tables) -> DataFrame:
    return t.source_items.orderBy(F.desc_nulls_last("published_at"), F.desc_nulls_last("updated_at"), "id").limit(50).select("id", "title")


@book.add("SELECT id, source_uid FROM source_items ORDER BY coalesce(published_at, updated_at, created_at) DESC, id LIMIT 20 OFFSET 40")
def t02_coalesced_page(t: Tables) -> DataFrame:
    return t.source_items.orderBy(F.coalesce("published_at", "updated_at", "created_at").desc(), "id").offset(40).limit(20).select("id", "source_uid")


@book.add("SELECT id, origin, title FROM canada_laws ORDER BY (origin = 'official') DESC, title, id LIMIT 40")
def t06_boolean_order(t: Tables) -> DataFrame:
    return t.canada_laws.orderBy((F.col("origin") == "official").desc(), "title", "id").limit(40).select("id", "origin", "title")


@book.add("""WITH x AS (SELECT id, 'exact' AS how FROM canada_laws WHERE lower(title) = 'no such act'), f AS (SELECT id, 'fallback' AS how FROM canada_laws WHERE lower(title) LIKE '%lighting act%')
    SELECT * FROM x UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM x)""")
def u01_exact_else_fallback(t: Tables) -> DataFrame:
    exact = t.canada_laws.filter(F.lower("title") == "no such act").select("id", F.lit("exact").alias("how"))
    return R.exact_else_fallback(exact, t.canada_laws.filter(F.lower("title").contains("lighting act")).select("id", F.lit("fallback").alias("how")))


@book.add("""WITH a AS (SELECT id, 1 AS tier FROM rag_chunks WHERE lower(title) LIKE '%safety%'), b AS (SELECT id, 2 AS tier FROM rag_chunks WHERE lower(text_content) LIKE '%safety%' AND id NOT IN (SELECT id FROM a)),
    c AS (SELECT id, 3 AS tier FROM rag_chunks WHERE jurisdiction = 'Canada' AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def u02_tiered_union(t: Tables) -> DataFrame:
    # one pass with the first tier that holds equals the chain of unions and anti joins
    tier = F.when(F.lower("title").contains("safety"), 1).when(F.lower("text_content").contains("safety"), 2).when(F.col("jurisdiction") == "Canada", 3)
    return t.rag_chunks.select("id", tier.alias("tier")).filter("tier is not null")


@book.add("""SELECT 'unchunked' AS side, s.id FROM source_items s WHERE s.id NOT IN (SELECT source_id FROM rag_chunks WHERE source_table = 'source_items')
    UNION ALL SELECT 'orphan', c.source_id FROM (SELECT DISTINCT source_id FROM rag_chunks WHERE source_table = 'source_items') c WHERE c.source_id NOT IN (SELECT id FROM source_items)""")
def u03_set_difference(t: Tables) -> DataFrame:
    have = t.source_items.select("id")
    used = t.rag_chunks.filter("source_table = 'source_items'").select(F.col("source_id").alias("id"))
    return R.set_difference(have, used, ["id"]).select(F.lit("unchunked").alias("side"), "id").unionByName(R.set_difference(used, have, ["id"]).select(F.lit("orphan").alias("side"), "id"))
