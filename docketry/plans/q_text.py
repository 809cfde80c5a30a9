"""Predicates, scalar functions and text functions over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import arrays as V
from docketry.functions import text as X
from docketry.plans.book import Book, Tables

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def module_clause(module: str):
    """The rows of a module: all, canada, case, law, or one source code."""
    case = F.col("source_table") == "source_items"
    return {"all": F.lit(True), "canada": F.col("source_table").isin("source_items", "canada_laws"), "case": case, "law": ~case}.get(module, F.lower("source_code") == module)


@book.add("SELECT 'case' AS module, count(*) AS n FROM rag_chunks WHERE source_table = 'source_items' UNION ALL SELECT 'law', count(*) FROM rag_chunks WHERE source_table <> 'source_items' UNION ALL SELECT 'canlii', count(*) FROM rag_chunks WHERE lower(source_code) = 'canlii'")
def p01_module_filter(t: Tables) -> DataFrame:
    names = ("case", "law", "canlii")
    one = t.rag_chunks.agg(*[F.count_if(module_clause(m)).alias(m) for m in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.col(m).alias("n")) for m in names])).alias("r")).select("r.module", "r.n")


@book.add(r"""SELECT id FROM rag_chunks WHERE lower(coalesce(jurisdiction, '')) = 'ontario' OR regexp_matches(lower(coalesce(citation, '')), '(^|[^a-z])(onca|onsc|oncj|onltb|onxc)([^a-z]|$)')
    INTERSECT SELECT id FROM rag_chunks WHERE published_at >= TIMESTAMP '1990-01-01' AND published_at < TIMESTAMP '2020-01-01'""")
def p02_structured_filter(t: Tables) -> DataFrame:
    place = (F.lower(F.coalesce("jurisdiction", F.lit(""))) == "ontario") | F.lower(F.coalesce("citation", F.lit(""))).rlike("(^|[^a-z])(onca|onsc|oncj|onltb|onxc)([^a-z]|$)")
    return t.rag_chunks.filter(place & (F.col("published_at") >= F.lit("1990-01-01").cast("timestamp_ntz")) & (F.col("published_at") < F.lit("2020-01-01").cast("timestamp_ntz"))).select("id")


@book.add("""SELECT s.id FROM source_items s WHERE lower(s.title) LIKE '%safety%' OR lower(s.raw_text) LIKE '%easement%' OR EXISTS (SELECT 1 FROM canada_case_law_links k WHERE k.case_item_id = s.id AND lower(k.matched_alias) LIKE '%safety%')""")
def p03_keyword_or_bridge(t: Tables) -> DataFrame:
    tagged = t.canada_case_law_links.filter(F.lower("matched_alias").contains("safety")).select(F.col("case_item_id").alias("id")).distinct().withColumn("tag", F.lit(True))
    rows = t.source_items.select("id", "title", "raw_text").join(tagged, "id", "left")
    return rows.filter(F.lower("title").contains("safety") | F.lower("raw_text").contains("easement") | F.col("tag")).select("id")


WORDS = (("easement", 1.0), ("safety", 0.85), ("costs", 0.35))
SCORE = " + ".join(f"{w} * (5 * (lower(coalesce(title, '')) LIKE '%{x}%')::INT + (lower(coalesce(raw_text, '')) LIKE '%{x}%')::INT + 3 * (lower(coalesce(summary, '')) LIKE '%{x}%')::INT)" for x, w in WORDS)


@book.add(f"SELECT id, round(CAST({SCORE} AS DOUBLE), 4) AS score FROM source_items WHERE ({SCORE}) > 0")
def p04_weighted_keywords(t: Tables) -> DataFrame:
    has = lambda c, x: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(x), 1).otherwise(0)
    score = sum((w * (5 * has("title", x) + has("raw_text", x) + 3 * has("summary", x)) for x, w in WORDS), F.lit(0.0))
    return t.source_items.select("id", F.round(score, 4).alias("score")).filter(F.col("score") > 0)


@book.add("SELECT matched_alias AS keyword, CAST(CASE WHEN length(matched_alias) <= 4 THEN 0.95 WHEN length(matched_alias) <= 7 THEN 0.75 ELSE 0.55 END AS DOUBLE) AS threshold, count(*) AS n FROM canada_case_law_links WHERE matched_alias IS NOT NULL GROUP BY 1, 2")
def p05_adaptive_threshold(t: Tables) -> DataFrame:
    n = F.length("matched_alias")
    return t.canada_case_law_links.filter("matched_alias is not null").groupBy(F.col("matched_alias").alias("keyword"), F.when(n <= 4, 0.95).when(n <= 7, 0.75).otherwise(0.55).alias("threshold")).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT id, CASE WHEN source_table = 'canada_laws' THEN 'law' WHEN lower(coalesce(source_code, '')) LIKE '%ofac%' THEN 'ofac' WHEN lower(coalesce(source_code, '')) IN ('a2aj_case', 'canlii', 'url_canada_case', 'manual_canada_case') THEN 'case' ELSE 'document' END AS kind FROM rag_chunks")
def p07_source_kind(t: Tables) -> DataFrame:
    c = F.lower(F.coalesce("source_code", F.lit("")))
    kind = F.when(F.col("source_table") == "canada_laws", "law").when(c.contains("ofac"), "ofac").when(c.isin("a2aj_case", "canlii", "url_canada_case", "manual_canada_case"), "case").otherwise("document")
    return t.rag_chunks.select("id", kind.alias("kind"))


@book.add("SELECT id, coalesce(nullif(trim(citation), ''), nullif(trim(section_title), ''), nullif(trim(title), ''), '') AS shown, substr(lower(coalesce(nullif(trim(jurisdiction), ''), nullif(trim(court_level), ''), '')), 1, 20) AS place FROM rag_chunks")
def p08_first_text(t: Tables) -> DataFrame:
    c = F.col
    return t.rag_chunks.select("id", X.first_text(c("citation"), c("section_title"), c("title")).alias("shown"), F.substring(F.lower(X.first_text(c("jurisdiction"), c("court_level"))), 1, 20).alias("place"))


@book.add("SELECT id, json_extract_string(raw_json, '$.jurisdiction') AS jurisdiction, json_extract_string(raw_json, '$.court_code') AS court_code FROM source_items WHERE raw_json IS NOT NULL")
def p09_pruned_metadata(t: Tables) -> DataFrame:
    keep = F.from_json("raw_json", "struct<jurisdiction: string, court_code: string>")
    return t.source_items.filter("raw_json is not null").select("id", keep.alias("m")).select("id", "m.jurisdiction", "m.court_code")


COURT = r"/[^/]*/?[0-9]{4}-([a-z]+)-[0-9]+"


@book.add(f"""SELECT code, CAST(CASE WHEN code IN ('scc', 'uksc') THEN 5 WHEN code LIKE '%ca' THEN 4 WHEN code LIKE '%sc' THEN 3 WHEN code LIKE '%cj' OR code LIKE '%pc' THEN 2 WHEN code <> '' THEN 1 ELSE 0 END AS INT) AS level, count(*) AS n
    FROM (SELECT regexp_extract(lower(coalesce(item_url, '')), '{COURT}', 1) AS code FROM source_items) GROUP BY 1, 2""")
def p10_court_level(t: Tables) -> DataFrame:
    code = F.regexp_extract(F.lower(F.coalesce("item_url", F.lit(""))), COURT, 1)
    c = F.col("code")
    level = F.when(c.isin("scc", "uksc"), 5).when(c.endswith("ca"), 4).when(c.endswith("sc"), 3).when(c.endswith("cj") | c.endswith("pc"), 2).when(c != "", 1).otherwise(0)
    return t.source_items.select(code.alias("code")).groupBy("code", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT CASE WHEN jurisdiction = 'Canada' THEN 'national' WHEN coalesce(jurisdiction, '') = '' THEN 'other' ELSE 'provincial' END AS scope, count(*) AS n FROM canada_laws GROUP BY 1")
def p11_scope(t: Tables) -> DataFrame:
    j = F.coalesce("jurisdiction", F.lit(""))
    return t.canada_laws.groupBy(F.when(j == "Canada", "national").when(j == "", "other").otherwise("provincial").alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@book.add("""SELECT a.id, max(b.id) AS existing FROM source_items a JOIN source_items b ON a.source_code IS NOT DISTINCT FROM b.source_code AND a.source_uid IS NOT DISTINCT FROM b.source_uid AND b.id < a.id GROUP BY 1""")
def p12_null_safe_identity(t: Tables) -> DataFrame:
    # a window takes nulls as equal; the row before is the largest smaller id, and no pair is made
    before = F.lag("id").over(Window.partitionBy("source_code", "source_uid").orderBy("id"))
    return t.source_items.select("id", before.alias("existing")).filter("existing is not null")


@book.add("SELECT id, parse_host AS host FROM (SELECT id, regexp_extract(item_url, '^https?://([^/:?#]+)', 1) AS parse_host, starts_with(item_url, 'https://') AS safe FROM source_items) WHERE safe AND (parse_host = 'example.org' OR ends_with(parse_host, '.example.org'))")
def p16_source_allow_list(t: Tables) -> DataFrame:
    host = F.try_parse_url("item_url", F.lit("HOST"))
    return t.source_items.filter(F.col("item_url").startswith("https://")).select("id", host.alias("host")).filter((F.col("host") == "example.org") | F.col("host").endswith(".example.org"))


ACL = ("Ontario", "canlii", "on_statute")


@book.add("SELECT id FROM rag_chunks WHERE len(list_intersect(list_filter([jurisdiction, source_code, source_kind, document_type, court_level], lambda x: x IS NOT NULL), ['Ontario', 'canlii', 'on_statute'])) > 0")
def p14_access_list(t: Tables) -> DataFrame:
    keys = F.array_compact(F.array("jurisdiction", "source_code", "source_kind", "document_type", "court_level"))
    return t.rag_chunks.filter(F.arrays_overlap(keys, F.array(*map(F.lit, ACL)))).select("id")


@book.add("""SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 10 AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AND ts >= (SELECT min(ts) + INTERVAL 5 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25""")
def p17_history_filter(t: Tables) -> DataFrame:
    first = F.broadcast(t.events.agg((F.min("ts") + F.expr("interval 5 days")).alias("_from")))
    rows = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 10) & (F.get_json_object("props", "$.k").cast("int") % 2 == 0)).join(first, F.col("ts") >= F.col("_from"))
    return rows.orderBy(F.desc("ts"), "event_id").offset(25).limit(25).select("event_id", "user_id")


@book.add("SELECT json_extract_string(raw_json, '$.fetch_mode') AS mode, count(*) AS n FROM source_items GROUP BY 1")
def p18_json_path_count(t: Tables) -> DataFrame:
    return t.source_items.groupBy(F.get_json_object("raw_json", "$.fetch_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT event_id, CASE WHEN event_type LIKE 'err%' OR coalesce(value, 0) < 0 THEN 'invalid' ELSE 'active' END AS status FROM events")
def p19_invalidation(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_type").rlike("^err") | (F.coalesce("value", F.lit(0.0)) < 0), "invalid").otherwise("active").alias("status"))


@book.add("""SELECT id FROM source_items WHERE lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')) LIKE '%lighting act%'
    OR (lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')) LIKE '%sealed%' AND lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')) LIKE '%mortgage%')""")
def p20_keyword_or_all_words(t: Tables) -> DataFrame:
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("raw_text", F.lit(""))))
    keywords = F.array(F.lit("lighting act"), F.lit("sealed mortgage"))
    hit = F.exists(keywords, lambda k: F.contains(F.col("body"), k) | ((k == "sealed mortgage") & F.forall(F.split(k, " "), lambda w: F.contains(F.col("body"), w))))
    return t.source_items.select("id", body.alias("body")).filter(hit).select("id")


@book.add(r"SELECT id, CAST(len(regexp_extract_all(coalesce(title, ''), 'Ã.|Â.|â€|ï¿½|\x{fffd}')) AS INT) AS marks FROM source_items")
def f02_garble_marks(t: Tables) -> DataFrame:
    return t.source_items.select("id", X.garble_marks(F.coalesce("title", F.lit(""))).alias("marks"))


@book.add(r"SELECT id, trim(regexp_replace(regexp_replace(raw_text, '<[^>]+>', ' ', 'g'), '[\t\n\f\r\x{b} ]+', ' ', 'g')) AS preview FROM source_items WHERE raw_text IS NOT NULL")
def f03_plain_preview(t: Tables) -> DataFrame:
    return t.source_items.filter("raw_text is not null").select("id", X.plain_preview(F.col("raw_text")).alias("preview"))


@book.add()
def f01_repaired_text(t: Tables) -> DataFrame:
    return t.source_items.select("id", X.repair_text(F.col("raw_text")).alias("repaired"))


@book.add()
def f04_split_keywords(t: Tables) -> DataFrame:
    return t.rag_chunks.select("id", X.split_keywords(F.coalesce("title", F.lit(""))).alias("keywords"))


@book.add("SELECT id, CAST(epoch_us(CAST(strftime(published_at, '%Y-%m-%d') AS TIMESTAMP)) // 1000000 AS BIGINT) AS seconds FROM source_items WHERE published_at IS NOT NULL")
def f05_parsed_dates(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Mon, "), F.date_format("published_at", "dd MMM yyyy"), F.lit(" 00:00:00 +0000"))
    return t.source_items.filter("published_at is not null").select("id", F.unix_seconds(X.parse_when(text)).alias("seconds"))


@book.add("SELECT case_item_id, sha256(array_to_string(list_sort(list(DISTINCT lower(trim(matched_alias)))), '|')) AS fingerprint FROM canada_case_law_links WHERE trim(matched_alias) <> '' GROUP BY 1")
def f06_fingerprints(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.filter(F.trim("matched_alias") != "")
    return rows.groupBy("case_item_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("matched_alias")))), "|"), 256).alias("fingerprint"))


@book.add(r"SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9\x{4e00}-\x{9fff}]+', ' ', 'g')) AS name, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS slug FROM canada_laws")
def f07_normal_names(t: Tables) -> DataFrame:
    return t.canada_laws.select("id", X.normal_name(F.col("title")).alias("name"), X.slug(F.col("title")).alias("slug"))


TERMS_SQL = r"list_sort(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z0-9]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,}}')))"


@book.add("SELECT id, array_to_string(" + TERMS_SQL.format("title") + ", ' ') AS terms FROM source_items WHERE title IS NOT NULL")
def f08_terms(t: Tables) -> DataFrame:
    return t.source_items.filter("title is not null").select("id", F.array_join(X.terms(F.col("title")), " ").alias("terms"))


@book.add(r"SELECT id, CAST(len(regexp_extract_all(text_content, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[^\t\n\f\r\x{b} A-Za-z0-9_\x{4e00}-\x{9fff}]')) AS INT) AS tokens FROM rag_chunks WHERE text_content IS NOT NULL")
def f09_token_estimate(t: Tables) -> DataFrame:
    return t.rag_chunks.filter("text_content is not null").select("id", X.token_estimate(F.col("text_content")).alias("tokens"))


TRIGRAMS_SQL = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@book.add(f"""WITH g AS (SELECT l.id, {TRIGRAMS_SQL.format('l.title')} AS a, {TRIGRAMS_SQL.format('l.normalized_title')} AS b, {TRIGRAMS_SQL.format("'wharf lighting act'")} AS q FROM canada_laws l)
    SELECT id, round(len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))), 6) AS similarity FROM g WHERE len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) >= 0.3""")
def f10_trigram_similarity(t: Tables) -> DataFrame:
    s = V.jaccard(X.trigrams(F.col("title")), X.trigrams(F.lit("wharf lighting act")))
    return t.canada_laws.select("id", s.alias("s")).filter("s >= 0.3").select("id", F.round("s", 6).alias("similarity"))


@book.add()
def f11_text_similarity(t: Tables) -> DataFrame:
    a, b = F.coalesce("title", F.lit("")), F.coalesce("normalized_title", F.lit(""))
    both = F.greatest(V.jaccard(X.bigrams(a), X.bigrams(b)), X.sequence_ratio(F.lower(a), F.lower(b)))
    return t.canada_laws.select("id", F.round(both, 4).alias("similarity"))


@book.add(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN h / greatest(h + l, 1) >= 0.6 THEN 'zh' WHEN h / greatest(h + l, 1) <= 0.1 THEN 'en' ELSE 'mixed' END AS script FROM c""")
def f12_script_language(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", X.script_language(F.col("text")).alias("script"))


CITATION = r"((?:19|20)[0-9]{2} [A-Z]{2,6} [0-9]{1,5}|[A-Z]\.[A-Z.]+ (?:19|20)[0-9]{2}, c\. [0-9]+)"


@book.add(f"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(citation, '') || ' ' || coalesce(title, ''), '{CITATION}', 1))), '; ') AS citations FROM rag_chunks")
def f17_citations(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("citation", F.lit("")), F.coalesce("title", F.lit("")))
    return t.rag_chunks.select("id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))), "; ").alias("citations"))


@book.add(f"SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' <c' || c_custkey || '@mail.example.org>, 416-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '{X.EMAIL}', '[email]', 'g'), '{X.PHONE}', '[phone]', 'g') AS shown FROM customer")
def f18_redacted(t: Tables) -> DataFrame:
    raw = F.concat("c_name", F.lit(" <c"), F.col("c_custkey").cast("string"), F.lit("@mail.example.org>, 416-555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    return t.customer.select("c_custkey", X.redact(raw).alias("shown"))


@book.add("SELECT id, lower(coalesce(raw_text, '')) LIKE '%without notice%' AS quarantined, sha256(coalesce(raw_text, '')) AS content_hash FROM source_items")
def f19_injection_scan(t: Tables) -> DataFrame:
    marks = X.injection_marks(F.col("raw_text"), ("without notice",))
    return t.source_items.select("id", (F.size(marks) > 0).alias("quarantined"), F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("content_hash"))


@book.add("""WITH o AS (SELECT source_code, source_uid, arg_min(coalesce(raw_text, ''), id) AS t FROM source_items WHERE source_code IS NOT NULL AND source_uid IS NOT NULL AND id % 3 <> 0 GROUP BY 1, 2),
    n AS (SELECT source_code, source_uid, arg_max(coalesce(raw_text, ''), id) AS t FROM source_items WHERE source_code IS NOT NULL AND source_uid IS NOT NULL AND id % 5 <> 0 GROUP BY 1, 2)
    SELECT coalesce(o.source_code, n.source_code) AS source_code, coalesce(o.source_uid, n.source_uid) AS source_uid,
    CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'deactivated' WHEN o.t = n.t THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.source_code = n.source_code AND o.source_uid = n.source_uid""")
def f20_version_diff(t: Tables) -> DataFrame:
    rows = t.source_items.filter("source_code is not null and source_uid is not null").select("id", "source_code", "source_uid", F.coalesce("raw_text", F.lit("")).alias("t"))
    old = rows.filter("id % 3 <> 0").groupBy("source_code", "source_uid").agg(F.min_by("t", "id").alias("a"))
    new = rows.filter("id % 5 <> 0").groupBy("source_code", "source_uid").agg(F.max_by("t", "id").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deactivated").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated")
    return old.join(new, ["source_code", "source_uid"], "full").select("source_code", "source_uid", change.alias("change"))


@book.add("""SELECT id, substr(text_content, greatest(instr(lower(text_content), 'without notice') - 70, 1), CAST(instr(lower(text_content), 'without notice') - greatest(instr(lower(text_content), 'without notice') - 70, 1) + 14 + 90 AS BIGINT)) AS highlight
    FROM rag_chunks WHERE instr(lower(text_content), 'without notice') > 0""")
def f21_highlights(t: Tables) -> DataFrame:
    return t.rag_chunks.select("id", X.highlight(F.col("text_content"), F.lit("without notice")).alias("highlight")).filter("highlight is not null")


@book.add("SELECT id, round(log2(1 + coalesce(token_count, 0)), 6) AS gain, round(ln(1 + coalesce(token_count, 0)), 6) AS logged, round(least(greatest(sqrt(coalesce(token_count, 0)) / 20, 0), 1), 6) AS clamped FROM rag_chunks")
def f23_math(t: Tables) -> DataFrame:
    n = F.coalesce("token_count", F.lit(0))
    return t.rag_chunks.select("id", F.round(F.log2(n + 1), 6).alias("gain"), F.round(F.log1p(n), 6).alias("logged"), F.round(F.least(F.greatest(F.sqrt(n) / 20, F.lit(0.0)), F.lit(1.0)), 6).alias("clamped"))


@book.add("SELECT id, CAST(coalesce(len(CAST(TRY_CAST(aliases_json AS JSON) AS VARCHAR[])), 0) AS INT) AS aliases FROM canada_laws")
def f24_json_or_default(t: Tables) -> DataFrame:
    return t.canada_laws.select("id", F.coalesce(F.size(F.from_json("aliases_json", "array<string>")), F.lit(0)).alias("aliases"))


@book.add("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, coalesce(TRY_CAST(event_type AS INT), -1) AS bad FROM events")
def f25_safe_casts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("k"), F.coalesce(F.col("event_type").try_cast("int"), F.lit(-1)).alias("bad"))


@book.add("SELECT id, array_to_string(list_slice(list_filter([title, normalized_title, citation], lambda x: trim(coalesce(x, '')) <> ''), 1, 2), '|') AS names FROM canada_laws WHERE lower(title) <> title AND title <> citation")
def f26_unique_capped(t: Tables) -> DataFrame:
    names = F.slice(V.unique(F.array("title", "normalized_title", "citation")), 1, 2)
    return t.canada_laws.filter("lower(title) <> title and title <> citation").select("id", F.array_join(names, "|").alias("names"))


@book.add("""SELECT id, substr(concat_ws(' | ', CASE WHEN trim(coalesce(title, '')) <> '' THEN 'Title: ' || trim(title) END, CASE WHEN trim(coalesce(citation, '')) <> '' THEN 'Citation: ' || trim(citation) END,
    CASE WHEN trim(coalesce(jurisdiction, '')) <> '' THEN 'Place: ' || trim(jurisdiction) END), 1, 2400) AS prefix FROM rag_chunks""")
def f27_prefix(t: Tables) -> DataFrame:
    return t.rag_chunks.select("id", X.labelled_prefix({"Title": F.col("title"), "Citation": F.col("citation"), "Place": F.col("jurisdiction")}).alias("prefix"))


@book.add("SELECT chunk_id, round(list_sum(list_transform(embedding_vector, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares FROM rag_chunk_embeddings WHERE embedding_vector IS NOT NULL AND len(list_filter(embedding_vector, lambda x: isnan(x))) = 0")
def f31_vector_text(t: Tables) -> DataFrame:
    rows = t.rag_chunk_embeddings.filter(F.col("embedding_vector").isNotNull() & ~F.exists("embedding_vector", lambda x: F.isnan(x)))
    told = F.concat(F.lit("["), F.array_join(F.transform("embedding_vector", lambda x: x.cast("double").cast("string")), ","), F.lit("]"))
    read = F.from_json(told, "array<double>")
    return rows.select("chunk_id", F.round(F.aggregate(read, F.lit(0.0), lambda s, x: s + x * x), 4).alias("squares"))


@book.add(r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<html><head><style>p{}</style></head><body><!-- x --><p>' || title || '</p><script>var a = 1;</script></body></html>', '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\t\n\f\r\x{b} ]+', ' ', 'g')) AS visible FROM canada_laws")
def s07_visible_text(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><!-- x --><p>"), "title", F.lit("</p><script>var a = 1;</script></body></html>"))
    return t.canada_laws.select("id", X.html_text(page).alias("visible"))
