"""Keyword, vector, hybrid and graph retrieval, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import arrays as V
from docketry.functions import text as X
from docketry.functions import vectors as VX
from docketry.operators import graph as G
from docketry.operators import relational as R
from docketry.operators import retrieval as I
from docketry.plans.book import Book, Tables
from docketry.runtime import head_table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

TERMS = ("easement", "lease", "costs")
GOOD = "len(embedding_vector) = dimension AND embedding_model = 'lexvec-base' AND len(list_filter(embedding_vector, lambda x: isnan(x))) = 0 AND len(list_filter(embedding_vector, lambda x: x <> 0)) > 0"
Q_SQL = f"q AS (SELECT embedding_vector::DOUBLE[] AS v, chunk_id AS qid FROM rag_chunk_embeddings WHERE {GOOD} ORDER BY chunk_id LIMIT 1)"
V_SQL = f"v AS (SELECT chunk_id, embedding_vector::DOUBLE[] AS x FROM rag_chunk_embeddings WHERE {GOOD})"
LIKE_SQL = " + ".join(f"CASE WHEN lower(coalesce(title, '')) LIKE '%{x}%' THEN 0.35 ELSE 0 END + CASE WHEN lower(coalesce(text_content, '')) LIKE '%{x}%' THEN 0.08 ELSE 0 END" for x in TERMS)


def vectors_of(t: Tables) -> DataFrame:
    """The vectors of one model whose length is what their row says; components are looked at where they are scored."""
    return t.rag_chunk_embeddings.filter((F.size("embedding_vector") == F.col("dimension")) & (F.col("embedding_model") == "lexvec-base"))


def query_vector(t: Tables) -> list[float]:
    """The vector asked with: one row, the usable one with the smallest id."""
    rows = vectors_of(t).select("chunk_id", "embedding_vector").orderBy("chunk_id")
    fine = lambda x: all(c is not None and c == c for c in x) and any(x)
    # the smallest ids first; only where none of them is usable are all looked at
    for r in rows.limit(64).collect():
        if fine(r["embedding_vector"]):
            return [float(x) for x in r["embedding_vector"]]
    v = F.col("embedding_vector")
    return [float(x) for x in rows.filter(~F.exists(v, lambda x: F.isnan(x)) & F.exists(v, lambda x: x != 0)).first()["embedding_vector"]]


def near(t: Tables, *more: str) -> DataFrame:
    """(chunk_id, score) of every usable vector, with further columns."""
    return vectors_of(t).select("chunk_id", *more, VX.cosine_to(query_vector(t), F.col("embedding_vector")).alias("score")).filter("score is not null")


@book.add()
def r01_postings(t: Tables) -> DataFrame:
    return I.postings(t.rag_chunks, "id", "text_content").select("term", "id", "tf")


@book.add()
def r02_strict_match(t: Tables) -> DataFrame:
    return I.strict_match(I.postings(t.rag_chunks, "id", "text_content"), "id", "verbal testimony")


@book.add()
def r03_must_any_stems(t: Tables) -> DataFrame:
    return I.must_and_any(I.postings(t.rag_chunks, "id", "text_content"), "id", "testimoni", ["easement", "leas"])


@book.add(r"""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(text_content, '')), '[a-z][a-z0-9]{2,}|[\x{4e00}-\x{9fff}]{2,}')) AS t FROM rag_chunks)
    SELECT id FROM w WHERE list_contains(t, 'easement') AND (list_contains(t, 'lease') OR list_contains(t, 'costs'))""")
def r03_must_any_terms(t: Tables) -> DataFrame:
    w = X.terms(F.coalesce("text_content", F.lit("")))
    return t.rag_chunks.select("id", w.alias("t")).filter(F.array_contains("t", "easement") & (F.array_contains("t", "lease") | F.array_contains("t", "costs"))).select("id")


@book.add(f"SELECT id, CAST({LIKE_SQL} AS DOUBLE) AS score FROM rag_chunks WHERE source_table = 'source_items' AND ({LIKE_SQL}) > 0 ORDER BY score DESC, published_at DESC NULLS LAST, id LIMIT 30")
def r04_lexical_search(t: Tables) -> DataFrame:
    s = F.round(I.like_score(F.col("title"), F.col("text_content"), TERMS), 6)
    rows = t.rag_chunks.filter("source_table = 'source_items'").select("id", s.alias("score"), "published_at").filter("score > 0")
    return rows.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "id").limit(30).select("id", "score")


@book.add(f"SELECT id, round(CAST({LIKE_SQL} AS DOUBLE), 6) AS score FROM rag_chunks WHERE ({LIKE_SQL}) > 0")
def r05_like_score(t: Tables) -> DataFrame:
    return t.rag_chunks.select("id", F.round(I.like_score(F.col("title"), F.col("text_content"), TERMS), 6).alias("score")).filter("score > 0")


@book.add(f"""WITH h AS (SELECT id, source_kind, jurisdiction, CAST({LIKE_SQL} AS DOUBLE) AS score FROM rag_chunks WHERE ({LIKE_SQL}) > 0)
    SELECT source_kind, coalesce(jurisdiction, '') AS jurisdiction, count(*) AS hits, round(max(score), 6) AS best, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM h GROUP BY 1, 2""")
def r06_faceted_search(t: Tables) -> DataFrame:
    hits = t.rag_chunks.select("source_kind", F.coalesce("jurisdiction", F.lit("")).alias("jurisdiction"), I.like_score(F.col("title"), F.col("text_content"), TERMS).alias("s")).filter("s > 0")
    facets = hits.groupBy("source_kind", "jurisdiction").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("s"), 6).alias("best"))
    total = facets.agg(F.sum("hits").alias("total"))
    return facets.join(F.broadcast(total), F.lit(True))


@book.add(f"""WITH h AS (SELECT id, source_table, source_id, CAST({LIKE_SQL} AS DOUBLE) AS s FROM rag_chunks WHERE ({LIKE_SQL}) > 0),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source_table, source_id ORDER BY s DESC, id) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY s DESC, id) AS r FROM b)
    SELECT id, source_table, round(s / greatest(1.0, max(s) OVER (PARTITION BY source_table)), 6) AS similarity FROM k WHERE r <= 12""")
def r07_fast_two_kinds(t: Tables) -> DataFrame:
    rows = t.rag_chunks.select("id", "source_table", "source_id", F.round(I.like_score(F.col("title"), F.col("text_content"), TERMS), 6).alias("s")).filter("s > 0")
    top = R.first_per_group(R.first_per_group(rows, ["source_table", "source_id"], [F.desc("s"), "id"]), ["source_table"], [F.desc("s"), "id"], 12)
    most = F.max("s").over(Window.partitionBy("source_table"))
    return top.select("id", "source_table", F.round(F.col("s") / F.greatest(F.lit(1.0), most), 6).alias("similarity"))


@book.add("""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS t FROM canada_laws), c AS (
    SELECT id, CAST(('0x' || substr(sha256(t), 1, 8))::BIGINT % 384 AS INT) AS idx, sum(CASE WHEN ('0x' || substr(sha256(t), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + least(length(t), 12) / 12.0::DOUBLE)) AS w FROM t GROUP BY 1, 2),
    n AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS n FROM c) SELECT id, idx, round(round(w / n, 8), 6) AS weight FROM n WHERE n > 0""")
def r09_hash_embedding(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return I.hash_embedding(t.canada_laws, "id", words).withColumn("weight", F.round("weight", 6))


@book.add(f"WITH {Q_SQL}, {V_SQL} SELECT chunk_id, round(list_cosine_similarity(x, q.v), 6) AS score FROM v, q ORDER BY score DESC, chunk_id LIMIT 20")
def r10_cosine_top(t: Tables) -> DataFrame:
    return near(t).orderBy(F.desc("score"), "chunk_id").limit(20)


@book.add(f"""WITH {Q_SQL}, n AS (SELECT chunk_id, embedding_vector::DOUBLE[] AS x FROM rag_chunk_embeddings WHERE {GOOD} ORDER BY updated_at DESC, chunk_id LIMIT 2000)
    SELECT chunk_id, round(list_cosine_similarity(x, q.v), 6) AS score FROM n, q WHERE list_cosine_similarity(x, q.v) > 0 ORDER BY score DESC, chunk_id LIMIT 10""")
def r11_newest_then_exact(t: Tables) -> DataFrame:
    newest = near(t, "updated_at").orderBy(F.desc("updated_at"), "chunk_id").limit(2000)
    return newest.filter("score > 0").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(10)


@book.add(f"""WITH {Q_SQL}, {V_SQL}, a AS (SELECT chunk_id, round(list_cosine_similarity(x, q.v), 6) AS score FROM v, q ORDER BY score DESC, chunk_id LIMIT 96)
    SELECT c.id, c.title, a.score FROM a JOIN rag_chunks c ON c.id = a.chunk_id JOIN rag_chunk_embeddings e ON e.chunk_id = c.id AND e.content_hash = c.content_hash WHERE c.source_table = 'source_items' ORDER BY a.score DESC, c.id LIMIT 24""")
def r12_top_then_join(t: Tables) -> DataFrame:
    best = head_table(near(t, "content_hash").withColumnRenamed("content_hash", "made_of").orderBy(F.desc("score"), "chunk_id"), 96)
    # 96 rows meet the wide table by a broadcast
    rows = t.rag_chunks.filter("source_table = 'source_items'").select("id", "title", "content_hash").join(F.broadcast(best.select(F.col("chunk_id").alias("id"), "score", "made_of")), "id")
    return rows.filter("content_hash = made_of").orderBy(F.desc("score"), "id").limit(24).select("id", "title", "score")


@book.add(f"""WITH {Q_SQL}, {V_SQL}, h AS (SELECT chunk_id, x, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: ((x[i] > 0) <> (q.v[i] > 0))::INT)) AS INT) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT 400)
    SELECT chunk_id, distance, round(list_cosine_similarity(x, q.v), 6) AS score FROM h, q ORDER BY score DESC, chunk_id LIMIT 10""")
def r13_hamming_then_exact(t: Tables) -> DataFrame:
    return I.hamming_then_exact(vectors_of(t), "chunk_id", "embedding_vector", query_vector(t), 10, 400).select("chunk_id", "distance", "score")


@book.add(f"""WITH {Q_SQL}, {V_SQL}, l AS (SELECT id, CASE WHEN jurisdiction = 'Ontario' THEN 1 ELSE 0 END AS scope, round(CAST({LIKE_SQL} AS DOUBLE), 6) AS lexical FROM rag_chunks WHERE ({LIKE_SQL}) > 0)
    SELECT l.id, CAST(l.scope AS INT) AS scope, round(list_cosine_similarity(v.x, q.v), 6) AS score, l.lexical FROM l JOIN v ON v.chunk_id = l.id, q ORDER BY scope DESC, score DESC, lexical DESC, id LIMIT 40""")
def r14_lexical_then_vector(t: Tables) -> DataFrame:
    l = t.rag_chunks.select("id", F.when(F.col("jurisdiction") == "Ontario", 1).otherwise(0).alias("scope"), F.round(I.like_score(F.col("title"), F.col("text_content"), TERMS), 6).alias("lexical")).filter("lexical > 0")
    v = near(t).withColumnRenamed("chunk_id", "id")
    return l.join(v, "id").orderBy(F.desc("scope"), F.desc("score"), F.desc("lexical"), "id").limit(40).select("id", "scope", "score", "lexical")


@book.add(f"""WITH {Q_SQL}, {V_SQL}, s AS (SELECT c.id, coalesce(c.jurisdiction = 'Ontario', false) AS ok, round(list_cosine_similarity(v.x, q.v), 6) AS score FROM v JOIN rag_chunks c ON c.id = v.chunk_id, q)
    SELECT id, score, CASE WHEN ok THEN 'scoped' ELSE 'open' END AS status FROM s WHERE ok OR NOT EXISTS (SELECT 1 FROM s WHERE ok) ORDER BY score DESC, id LIMIT 15""")
def r15_hard_scope(t: Tables) -> DataFrame:
    v = near(t).withColumnRenamed("chunk_id", "id")
    s = t.rag_chunks.select("id", F.coalesce(F.col("jurisdiction") == "Ontario", F.lit(False)).alias("ok")).join(v, "id")
    both = R.exact_else_fallback(s.filter("ok"), s.filter("not ok"))
    return both.orderBy(F.desc("score"), "id").limit(15).select("id", "score", F.when(F.col("ok"), "scoped").otherwise("open").alias("status"))


@book.add("SELECT c.id, c.content_hash FROM rag_chunks c LEFT JOIN rag_chunk_embeddings e ON e.chunk_id = c.id WHERE e.chunk_id IS NULL OR e.content_hash <> c.content_hash ORDER BY c.id DESC LIMIT 32")
def r16_embedding_batch(t: Tables) -> DataFrame:
    made = t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("_h"), F.lit(1).alias("_made"))
    return R.missing_or_stale(t.rag_chunks.select("id", "content_hash"), made, "id", F.col("_h") != F.col("content_hash")).orderBy(F.desc("id")).limit(32).select("id", "content_hash")


@book.add("SELECT e.embedding_model, count(*) AS vectors, count(*) FILTER (WHERE e.content_hash = c.content_hash) AS fresh, count(c.id) AS with_chunk FROM rag_chunk_embeddings e LEFT JOIN rag_chunks c ON c.id = e.chunk_id GROUP BY 1")
def r17_vector_status(t: Tables) -> DataFrame:
    c = t.rag_chunks.select(F.col("id").alias("chunk_id"), F.col("content_hash").alias("h"))
    rows = t.rag_chunk_embeddings.select("chunk_id", "embedding_model", "content_hash").join(c, "chunk_id", "left")
    return rows.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("content_hash") == F.col("h")).alias("fresh"), F.count("h").alias("with_chunk"))


FUSION_SQL = f"""WITH {Q_SQL}, {V_SQL}, l0 AS (SELECT id, round(CAST({LIKE_SQL} AS DOUBLE), 6) AS score FROM rag_chunks WHERE ({LIKE_SQL}) > 0 ORDER BY score DESC, id LIMIT 60), l AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM l0),
    n0 AS (SELECT chunk_id AS id, round(list_cosine_similarity(x, q.v), 6) AS score FROM v, q ORDER BY score DESC, chunk_id LIMIT 60), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM n0)
    SELECT coalesce(l.id, n.id) AS id, round(coalesce(0.55::DOUBLE / (60 + l.r), 0) + coalesce(0.45::DOUBLE / (60 + n.r), 0) + greatest(coalesce(n.score, 0) - 0.5, 0) * 0.1, 6) AS hybrid_score,
    coalesce(l.score, 0) AS lexical_score, coalesce(n.score, 0) AS vector_score FROM l FULL JOIN n ON l.id = n.id ORDER BY hybrid_score DESC, vector_score DESC, lexical_score DESC, id LIMIT 40"""


@book.add(FUSION_SQL)
def r19_hybrid_search(t: Tables) -> DataFrame:
    l = t.rag_chunks.select("id", F.round(I.like_score(F.col("title"), F.col("text_content"), TERMS), 6).alias("s")).filter("s > 0")
    v = near(t).select(F.col("chunk_id").alias("id"), F.col("score").alias("s"))
    return I.fused({"lexical": I.ranked(l, "id", "s", 60), "vector": I.ranked(v, "id", "s", 60)}, "id", 40)


@book.add(f"""WITH {Q_SQL}, {V_SQL}, n AS (SELECT chunk_id AS id, round(list_cosine_similarity(x, q.v), 6) AS score FROM v, q), r AS (SELECT n.id, n.score, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(c.title, '') || ' ' || coalesce(c.text_content, '')), '[a-z]+')), ['easement', 'lease', 'costs'])) AS overlap
    FROM n JOIN rag_chunks c ON c.id = n.id) SELECT id, score, CAST(overlap AS INT) AS overlap FROM r WHERE NOT (overlap = 0 AND score < 0.58)""")
def r20_gated(t: Tables) -> DataFrame:
    v = near(t).withColumnRenamed("chunk_id", "id")
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text_content", F.lit("")))), F.lit("[a-z]+"), F.lit(0))
    rows = t.rag_chunks.select("id", F.size(F.array_intersect(words, F.array(*map(F.lit, TERMS)))).alias("overlap")).join(v, "id")
    return I.gated(rows, F.col("overlap"), F.lit(True), F.col("score"), F.lit(0.0)).select("id", "score", "overlap")


@book.add("""SELECT id, round(0.02 + least(0.006 * o, 0.036) + CASE WHEN coalesce(jurisdiction, '') = 'Ontario' THEN 0.04 ELSE 0 END + CASE WHEN source_table = 'source_items' THEN 0.006 ELSE 0.003 END - CASE WHEN lower(coalesce(title, '')) LIKE '%order%' THEN 0.018 ELSE 0 END, 6)::DOUBLE AS score FROM (
    SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text_content, '')), '[a-z]+')), ['easement', 'lease', 'costs'])) AS o FROM rag_chunks)""")
def r21_linear_rerank(t: Tables) -> DataFrame:
    o = F.size(F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("text_content", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, TERMS))))
    title = F.lower(F.coalesce("title", F.lit("")))
    s = 0.02 + F.least(0.006 * o, F.lit(0.036)) + F.when(F.col("jurisdiction") == "Ontario", 0.04).otherwise(0.0) + F.when(F.col("source_table") == "source_items", 0.006).otherwise(0.003) - F.when(title.contains("order"), 0.018).otherwise(0.0)
    return t.rag_chunks.select("id", F.round(s, 6).alias("score"))


@book.add()
def r22_context_windows(t: Tables) -> DataFrame:
    c = t.rag_chunks.select("id", "source_table", "source_id", "chunk_index", "section_title", "text_content")
    return I.context_windows(None, c, 1, 600)


@book.add("SELECT 'R' || row_number() OVER (ORDER BY token_count DESC, id) AS ref, id, CASE WHEN coalesce(trim(citation), '') <> '' AND coalesce(trim(source_url), '') <> '' THEN 'traceable' WHEN coalesce(trim(source_url), '') <> '' THEN 'partial' ELSE 'missing' END AS status FROM rag_chunks WHERE token_count IS NOT NULL ORDER BY token_count DESC, id LIMIT 12")
def r23_reference_list(t: Tables) -> DataFrame:
    top = t.rag_chunks.filter("token_count is not null").orderBy(F.desc("token_count"), "id").limit(12)
    n = F.row_number().over(Window.orderBy(F.desc("token_count"), "id"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return top.select(F.concat(F.lit("R"), n.cast("string")).alias("ref"), "id", F.when(~blank("citation") & ~blank("source_url"), "traceable").when(~blank("source_url"), "partial").otherwise("missing").alias("status"))


EDGES_SQL = """e AS (SELECT 'c' || case_item_id AS source_id, 'l' || law_id AS target_id, greatest(least(max(match_score), 0.95), 0.65) AS confidence FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1, 2)"""


def edges(t: Tables) -> DataFrame:
    """Case-law links as edges, confidence clamped to .65 .. .95."""
    k = t.canada_case_law_links.filter("law_id is not null")
    return k.groupBy(F.concat(F.lit("c"), F.col("case_item_id").cast("string")).alias("source_id"), F.concat(F.lit("l"), F.col("law_id").cast("string")).alias("target_id")).agg(F.greatest(F.least(F.max("match_score"), F.lit(0.95)), F.lit(0.65)).alias("confidence"))


@book.add(f"WITH {EDGES_SQL} SELECT source_id, target_id, round(confidence, 6) AS confidence, sha256(source_id || '|' || target_id || '|mentions') AS edge_key FROM e")
def r24_graph_seed(t: Tables) -> DataFrame:
    return edges(t).select("source_id", "target_id", F.round("confidence", 6).alias("confidence"), G.edge_key(F.col("source_id"), F.col("target_id"), F.lit("mentions")).alias("edge_key"))


@book.add("""WITH s AS (SELECT id, lower(title) AS n, string_split_regex(lower(title), '[^a-z0-9]+') AS w FROM canada_laws), b AS (SELECT id, greatest(
    CASE WHEN n = 'wharf lighting act' THEN 1.0 WHEN n LIKE '%wharf lighting act%' THEN 0.78 WHEN list_contains(w, 'wharf lighting act') THEN 0.72 ELSE 0.65 * least(1.0, len(list_intersect(w, ['wharf', 'lighting', 'act'])) / 3.0) END,
    CASE WHEN n = 'quota' THEN 1.0 WHEN list_contains(w, 'quota') THEN 0.72 ELSE 0.0 END) AS s FROM s)
    SELECT id, round(s::DOUBLE * (0.7 + 0.3 * 0.9::DOUBLE), 6) AS score FROM b WHERE round(s::DOUBLE * (0.7 + 0.3 * 0.9::DOUBLE), 6) >= 0.35 ORDER BY score DESC, id LIMIT 8""")
def r25_entry_scores(t: Tables) -> DataFrame:
    entities = t.canada_laws.select("id", F.col("title").alias("canonical_name"), F.lit(0.9).alias("confidence"))
    return G.entry_scores(entities, ["wharf lighting act", "quota"]).select("id", "score")


@book.add(f"""WITH RECURSIVE {EDGES_SQL}, u AS (SELECT source_id AS x, target_id AS y, confidence AS c FROM e UNION ALL SELECT target_id, source_id, confidence FROM e),
    s AS (SELECT min(target_id) AS node FROM e), l1 AS (SELECT y AS node, max(1.0::DOUBLE * c * 0.92) AS score FROM u JOIN s ON x = s.node GROUP BY 1), l2 AS (SELECT y AS node, max(score * c * 0.82) AS score FROM u JOIN l1 ON x = l1.node GROUP BY 1),
    l3 AS (SELECT y AS node, max(score * c * 0.82) AS score FROM u JOIN l2 ON x = l2.node GROUP BY 1), a AS (SELECT node, 1.0::DOUBLE AS score, 0 AS hops FROM s UNION ALL SELECT node, score, 1 FROM l1 UNION ALL SELECT node, score, 2 FROM l2 UNION ALL SELECT node, score, 3 FROM l3)
    SELECT node, round(max(score), 6) AS score, CAST(arg_min(hops, (-score, hops)) AS INT) AS hops FROM a GROUP BY 1""")
def r26_best_paths(t: Tables) -> DataFrame:
    e = edges(t)
    return G.best_paths(e, e.agg(F.min("target_id").alias("node")).select("node", F.lit(1.0).alias("score")), 3)


@book.add(f"""WITH {EDGES_SQL}, s AS (SELECT min(target_id) AS node FROM e), p AS (SELECT node, 1.0::DOUBLE AS score FROM s UNION ALL SELECT source_id, max(confidence * 0.92) FROM e JOIN s ON target_id = s.node GROUP BY 1),
    p2 AS (SELECT node, round(max(score), 6) AS path FROM p GROUP BY 1), k AS (SELECT c.id, 'c' || c.source_id AS entity, c.source_table || ':' || c.source_id AS document FROM rag_chunks c WHERE c.source_table = 'source_items'), j AS (SELECT k.id, document, round(path * 0.9, 6) AS score FROM k JOIN p2 ON p2.node = k.entity)
    SELECT id, document, score FROM j QUALIFY row_number() OVER (PARTITION BY document ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 30""")
def r27_graph_search(t: Tables) -> DataFrame:
    e = edges(t)
    paths = G.best_paths(e, e.agg(F.min("target_id").alias("node")).select("node", F.lit(1.0).alias("score")), 1)
    links = t.rag_chunks.filter("source_table = 'source_items'").select("id", F.concat(F.lit("c"), F.col("source_id").cast("string")).alias("entity"), F.concat_ws(":", "source_table", F.col("source_id").cast("string")).alias("document"), F.lit(0.9).alias("confidence"))
    return G.graph_search(paths, links).select("id", "document", "score")


@book.add(f"WITH {EDGES_SQL} SELECT substr(node, 1, 1) AS entity_type, count(*) AS nodes, CAST(sum(d) AS BIGINT) AS ends FROM (SELECT node, count(*) AS d FROM (SELECT source_id AS node FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1) GROUP BY 1")
def r28_graph_status(t: Tables) -> DataFrame:
    e = edges(t)
    ends = e.select(F.col("source_id").alias("node")).unionByName(e.select(F.col("target_id").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    return ends.groupBy(F.substring("node", 1, 1).alias("entity_type")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("ends"))


@book.add(f"""WITH {Q_SQL}, {V_SQL}, n AS (SELECT chunk_id, row_number() OVER (ORDER BY round(list_cosine_similarity(x, q.v), 6) DESC, chunk_id) AS r FROM v, q), h AS (SELECT chunk_id, row_number() OVER (ORDER BY list_sum(list_transform(range(1, len(x) + 1), lambda i: ((x[i] > 0) <> (q.v[i] > 0))::INT)), chunk_id) AS r FROM v, q)
    SELECT round(count(*) / 10.0, 6)::DOUBLE AS recall FROM n JOIN h ON h.chunk_id = n.chunk_id AND h.r <= 10 WHERE n.r <= 10""")
def f28_recall_at_k(t: Tables) -> DataFrame:
    q = query_vector(t)
    exact = I.exact_neighbours(vectors_of(t), "chunk_id", "embedding_vector", q, 10).agg(F.collect_list("chunk_id").alias("a"))
    signs = vectors_of(t).select("chunk_id", VX.hamming_to(q, F.col("embedding_vector")).alias("d")).filter("d is not null")
    coarse = signs.orderBy("d", "chunk_id").limit(10).agg(F.collect_list("chunk_id").alias("b"))
    return exact.join(F.broadcast(coarse), F.lit(True)).select(F.round(V.recall_at(F.col("a"), F.col("b"), 10), 6).alias("recall"))


RELEVANT_SQL = "SELECT case_item_id AS q, list(DISTINCT law_id) AS rel FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1"
RANKED_SQL = "SELECT case_item_id AS q, list(law_id ORDER BY match_score DESC NULLS LAST, id) AS got FROM (SELECT case_item_id, law_id, max(match_score) AS match_score, min(id) AS id FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


@book.add(f"""WITH r AS ({RELEVANT_SQL}), g AS ({RANKED_SQL}), m AS (SELECT list_filter(rel, lambda x: x % 2 = 0) AS rel, got FROM r JOIN g USING (q)), s AS (SELECT len(list_intersect(rel, list_slice(got, 1, 3))) > 0 AS hit,
    coalesce(1.0 / list_min(list_filter(list_transform(rel, lambda x: list_position(got, x)), lambda p: p > 0)), 0) AS rr FROM m WHERE len(rel) > 0)
    SELECT count(*) AS queries, round(avg(hit::INT), 6) AS hit_at_3, round(avg(rr), 6) AS mrr FROM s""")
def a21_hit_and_mrr(t: Tables) -> DataFrame:
    k = t.canada_case_law_links.filter("law_id is not null").groupBy("case_item_id", "law_id").agg(F.max("match_score").alias("m"), F.min("id").alias("i"))
    order = F.array_sort(F.collect_list(F.struct(F.negative(F.coalesce("m", F.lit(-1.0))).alias("a"), F.col("i").alias("b"), "law_id")))
    rows = k.groupBy("case_item_id").agg(F.transform(order, lambda x: x["law_id"]).alias("got")).withColumn("rel", F.filter("got", lambda x: x % 2 == 0)).filter(F.size("rel") > 0)
    hit = F.arrays_overlap("rel", F.slice("got", 1, 3)).cast("int")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(hit), 6).alias("hit_at_3"), F.round(F.avg(V.reciprocal_rank(F.col("rel"), F.col("got"))), 6).alias("mrr"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["r19_hybrid_search"](spark, sf_dir)
