"""Further operators: dictionaries in texts, planners, packets, governance, queues."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import arrays as V
from docketry.functions import planner as P
from docketry.functions import text as X
from docketry.operators import dictionary as D
from docketry.operators import evidence as E
from docketry.operators import relational as R
from docketry.operators import selection as L
from docketry.plans.book import Book, Tables
from docketry.runtime import checkpoint_dir

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


@book.add("SELECT id, trim(regexp_replace(regexp_replace('<law><t>' || replace(replace(title, '&', '&amp;'), '<', '&lt;') || '</t><n>' || id || '</n></law>', '<[^>]+>', ' ', 'g'), ' +', ' ', 'g')) AS text FROM canada_laws")
def s06_xml_text(t: Tables) -> DataFrame:
    clean = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<law><t>"), clean, F.lit("</t><n>"), F.col("id").cast("string"), F.lit("</n></law>"))
    return t.canada_laws.select("id", F.substring(X.plain_preview(xml), 1, 12000).alias("text"))


@book.add("SELECT id, chunk_index, token_count FROM rag_chunks")
def s12_json_lines(t: Tables) -> DataFrame:
    folder = f"{checkpoint_dir(t.spark)}/lines-{Path(t.sf_dir).name}"
    rows = t.rag_chunks.select("id", "chunk_index", "token_count")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    return t.spark.read.schema(rows.schema).json(folder)


@book.add("SELECT coalesce(jurisdiction, '') AS class, count(*) AS n, max(id) AS last_id, max(epoch_us(updated_at)) AS updated FROM canada_laws GROUP BY 1")
def s23_class_signatures(t: Tables) -> DataFrame:
    return t.canada_laws.groupBy(F.coalesce("jurisdiction", F.lit("")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.unix_micros(F.max(F.col("updated_at").cast("timestamp"))).alias("updated"))


@book.add("SELECT count(*) AS n FROM source_items WHERE lower(coalesce(title, '')) LIKE '%order%' OR lower(coalesce(raw_text, '')) LIKE '%wrongful pension%'")
def p06_local_matches(t: Tables) -> DataFrame:
    hit = F.lower(F.coalesce("title", F.lit(""))).contains("order") | F.lower(F.coalesce("raw_text", F.lit(""))).contains("wrongful pension")
    return t.source_items.agg(F.count_if(hit).alias("n"))


@book.add("SELECT c.id FROM rag_chunks c JOIN rag_chunk_embeddings e ON e.chunk_id = c.id AND e.content_hash = c.content_hash")
def p13_fresh_vectors(t: Tables) -> DataFrame:
    made = t.rag_chunk_embeddings.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("h"))
    return t.rag_chunks.select("id", "content_hash").join(made, "id").filter("content_hash = h").select("id")


@book.add("""SELECT source_table, source_id, array_to_string(list_sort(list(id) FILTER (WHERE coalesce(jurisdiction, '') IN ('Ontario', 'Canada'))), ',') AS granted, count(*) AS n FROM rag_chunks GROUP BY 1, 2 HAVING count(*) FILTER (WHERE coalesce(jurisdiction, '') IN ('Ontario', 'Canada')) > 0""")
def p15_restricted_bundles(t: Tables) -> DataFrame:
    # what is not granted never enters a bundle's array
    granted = F.when(F.coalesce("jurisdiction", F.lit("")).isin("Ontario", "Canada"), F.col("id"))
    rows = t.rag_chunks.groupBy("source_table", "source_id").agg(F.array_sort(F.collect_list(granted)).alias("g"), F.count(F.lit(1)).alias("n")).filter(F.size("g") > 0)
    return rows.select("source_table", "source_id", F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("granted"), "n")


@book.add("""WITH k AS (SELECT id, length(raw_text) AS n FROM source_items WHERE raw_text IS NOT NULL ORDER BY n DESC, id LIMIT 50) SELECT k.id, k.n, s.title FROM k JOIN source_items s ON s.id = k.id""")
def j09_top_then_join(t: Tables) -> DataFrame:
    top = t.source_items.filter("raw_text is not null").select("id", F.length("raw_text").cast("bigint").alias("n")).orderBy(F.desc("n"), "id").limit(50)
    return t.source_items.select("id", "title").join(F.broadcast(top), "id").select("id", "n", "title")


MENTION = r"([A-Z][a-z]+(?: [A-Z][a-z]+){1,4} (?:Act|Regulations|Rules))"


@book.add(rf"""WITH m AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(coalesce(evidence_excerpt, ''), '{MENTION}', 1))) AS t FROM canada_case_law_links), n AS (SELECT id AS law_id, lower(title) AS t FROM canada_laws WHERE origin = 'official')
    SELECT m.id, n.law_id FROM m JOIN n ON n.t = m.t OR ends_with(m.t, ' ' || n.t)""")
def j12_dictionary_in_text(t: Tables) -> DataFrame:
    m = t.canada_case_law_links.select("id", F.explode(F.regexp_extract_all(F.coalesce("evidence_excerpt", F.lit("")), F.lit(MENTION), F.lit(1))).alias("m")).select("id", F.lower("m").alias("m")).distinct()
    # every tail of a mention is a key of the equi-join, so no text meets all names
    parts = F.split("m", " ")
    tails = m.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), " "))).alias("t"))
    names = t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("law_id"), F.lower("title").alias("t"))
    return tails.join(names, "t").select("id", "law_id").distinct()


PHRASE = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


@book.add(f"""WITH x AS (SELECT 'excerpt' AS kind, id, ' ' || {PHRASE.format('evidence_excerpt')} || ' ' AS t FROM canada_case_law_links UNION ALL SELECT 'case', id, ' ' || {PHRASE.format("concat_ws(' ', title, summary, raw_text)")} || ' ' FROM source_items),
    n AS (SELECT DISTINCT law_id, {PHRASE.format('a')} AS p FROM (SELECT id AS law_id, unnest(list_concat([title, normalized_title, citation], coalesce(CAST(aliases_json AS VARCHAR[]), []))) AS a FROM (SELECT * REPLACE (from_json(aliases_json, '["VARCHAR"]') AS aliases_json) FROM canada_laws WHERE origin = 'official')))
    SELECT DISTINCT x.kind, x.id, n.law_id FROM x JOIN n ON n.p <> '' AND contains(x.t, ' ' || n.p || ' ')""")
def j12_names_in_text(t: Tables) -> DataFrame:
    excerpts = t.canada_case_law_links.select(F.lit("excerpt").alias("kind"), "id", F.col("evidence_excerpt").alias("text"))
    cases = t.source_items.select(F.lit("case").alias("kind"), "id", F.concat_ws(" ", "title", "summary", "raw_text").alias("text"))
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    names = t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("name_id"), F.explode(F.concat(F.array("title", "normalized_title", "citation"), aliases)).alias("name"))
    return D.names_in_text(excerpts.unionByName(cases), names).withColumnRenamed("name_id", "law_id")


@book.add("""SELECT c.id, e.embedding_model FROM rag_chunks c JOIN (SELECT DISTINCT source_table, source_id FROM rag_chunks WHERE chunk_index = 0) d ON d.source_table = c.source_table AND d.source_id = c.source_id JOIN rag_chunk_embeddings e ON e.chunk_id = c.id AND e.embedding_model = 'lexvec-base'""")
def j16_id_mapping(t: Tables) -> DataFrame:
    doc_map = t.rag_chunks.filter("chunk_index = 0").select("source_table", "source_id").distinct()
    chunk_map = t.rag_chunk_embeddings.filter("embedding_model = 'lexvec-base'").select(F.col("chunk_id").alias("id"), "embedding_model")
    return t.rag_chunks.select("id", "source_table", "source_id").join(doc_map, ["source_table", "source_id"], "left_semi").join(chunk_map, "id").select("id", "embedding_model")


@book.add("SELECT source_table || ':' || source_id AS document, id, CAST(token_count AS DOUBLE) AS score FROM rag_chunks WHERE token_count IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_table, source_id ORDER BY token_count DESC, id) = 1")
def w10_best_per_document(t: Tables) -> DataFrame:
    rows = t.rag_chunks.filter("token_count is not null").select("source_table", "source_id", "id", F.col("token_count").cast("double").alias("score"))
    return R.first_per_group(rows, ["source_table", "source_id"], [F.desc("score"), "id"]).select(F.concat_ws(":", "source_table", F.col("source_id").cast("string")).alias("document"), "id", "score")


@book.add()
def w12_degree_capped(t: Tables) -> DataFrame:
    k = t.canada_case_law_links.filter("law_id is not null and match_score is not null").groupBy(F.col("case_item_id").alias("a"), F.negative("law_id").alias("b")).agg(F.max("match_score").alias("similarity"))
    return L.degree_capped(k, 4)


@book.add("""WITH r AS (SELECT id, CASE WHEN source_table = 'canada_laws' THEN 'law' ELSE 'case' END AS kind, CASE WHEN source_table = 'canada_laws' THEN token_count / 1000.0::DOUBLE ELSE token_count::DOUBLE END AS score FROM rag_chunks WHERE token_count IS NOT NULL),
    k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS m FROM r), x AS (SELECT kind FROM k GROUP BY 1 HAVING min(n) > 8),
    h AS (SELECT id, kind, score FROM k WHERE n <= 8 - (SELECT count(*) FROM x) UNION ALL SELECT id, kind, score FROM k WHERE m = 1 AND kind IN (SELECT kind FROM x))
    SELECT id, kind, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM h""")
def w13_kinds_covered(t: Tables) -> DataFrame:
    law = F.col("source_table") == "canada_laws"
    score = F.when(law, F.col("token_count") / 1000.0).otherwise(F.col("token_count").cast("double"))
    rows = t.rag_chunks.filter("token_count is not null").select("id", F.when(law, "law").otherwise("case").alias("kind"), score.alias("score"))
    return L.covered(rows, ["case", "law"], 8)


@book.add("SELECT id, source_kind, token_count FROM rag_chunks WHERE token_count IS NOT NULL ORDER BY token_count DESC, source_kind DESC, id DESC LIMIT 40")
def t05_all_descending(t: Tables) -> DataFrame:
    return t.rag_chunks.filter("token_count is not null").orderBy(F.desc("token_count"), F.desc("source_kind"), F.desc("id")).limit(P.clamp_limit(40)).select("id", "source_kind", "token_count")


W_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


@book.add(f"""WITH w AS (SELECT id, {W_SQL.format('title')} AS a, {W_SQL.format("coalesce(law_kind, '') || ' ' || coalesce(jurisdiction, '') || ' ' || normalized_title")} AS b FROM canada_laws)
    SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, CAST(len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b)) AS INT) AS differing FROM w""")
def u04_u05_set_measures(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    a = words(F.col("title"))
    b = words(F.concat_ws(" ", F.coalesce("law_kind", F.lit("")), F.coalesce("jurisdiction", F.lit("")), "normalized_title"))
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return t.canada_laws.select("id", F.round(V.jaccard(a, b), 6).alias("jaccard"), apart.alias("differing"))


PLAN = P.plan("Can a landlord in Ontario end a lease? eviction costs")


@book.add("SELECT CASE WHEN source_table = 'canada_laws' THEN 'law' ELSE 'case' END AS partition, count(*) AS n FROM rag_chunks WHERE jurisdiction = 'Ontario' GROUP BY 1")
def r18_partitions_of_plan(t: Tables) -> DataFrame:
    kind = F.when(F.col("source_table") == "canada_laws", "law").otherwise("case")
    return t.rag_chunks.filter(F.col("jurisdiction").isin(PLAN["places"])).groupBy(kind.alias("partition")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("partition").isin(PLAN["kinds"]))


def _plan_sql() -> str:
    parts = " + ".join(f"CASE WHEN contains(lower(coalesce(text_content, '')), '{w}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for w, v in PLAN["terms"].items())
    return f"SELECT id, round({parts}, 4) AS score FROM rag_chunks WHERE jurisdiction IN ('Ontario') ORDER BY score DESC, id LIMIT 25"


@book.add(_plan_sql())
def r30_planned_search(t: Tables) -> DataFrame:
    low = F.lower(F.coalesce("text_content", F.lit("")))
    score = sum((F.when(F.contains(low, F.lit(w)), v).otherwise(0.0) for w, v in PLAN["terms"].items()), F.lit(0.0))
    return t.rag_chunks.filter(F.col("jurisdiction").isin(PLAN["places"])).select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(25)


ISSUES = (("breach", "breach|violat"), ("limitation", "limitation|prescri"), ("costs", "costs|dépens"), ("evidence", "evidence|testimony|preuve"), ("standing", "standing|qualité pour agir"))


@book.add("SELECT id, issue FROM (SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(raw_text), '{p}') THEN '{n}' END" for n, p in ISSUES) + "], lambda x: x IS NOT NULL)) AS issue FROM source_items WHERE raw_text IS NOT NULL)")
def r31_dispute_issues(t: Tables) -> DataFrame:
    low = F.lower("raw_text")
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), n) for n, p in ISSUES]))
    return t.source_items.filter("raw_text is not null").select("id", F.explode(F.slice(hits, 1, 6)).alias("issue"))


@book.add("SELECT law_id, count(DISTINCT case_item_id) AS cases, round(max(match_score), 4) AS best FROM canada_case_law_links WHERE law_id IS NOT NULL AND match_score IS NOT NULL GROUP BY 1 ORDER BY cases DESC, best DESC, law_id LIMIT 12")
def r32_prior_candidates(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.filter("law_id is not null and match_score is not null").groupBy("law_id").agg(F.countDistinct("case_item_id").alias("cases"), F.round(F.max("match_score"), 4).alias("best"))
    return rows.orderBy(F.desc("cases"), F.desc("best"), "law_id").limit(12)


@book.add("""WITH s AS (SELECT id, lower(coalesce(text_content, '')) AS x, token_count FROM rag_chunks), r1 AS (SELECT id, 1 AS round FROM s WHERE x LIKE '%easement%' ORDER BY token_count DESC NULLS LAST, id LIMIT 10),
    r2 AS (SELECT id, 2 AS round FROM s WHERE x LIKE '%mortgage%' AND id NOT IN (SELECT id FROM r1) ORDER BY token_count DESC NULLS LAST, id LIMIT 10), r3 AS (SELECT id, 3 AS round FROM s WHERE x LIKE '%zoning%' AND id NOT IN (SELECT id FROM r1) AND id NOT IN (SELECT id FROM r2) ORDER BY token_count DESC NULLS LAST, id LIMIT 10)
    SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3""")
def r33_bounded_rounds(t: Tables) -> DataFrame:
    rows = t.rag_chunks.select("id", F.lower(F.coalesce("text_content", F.lit(""))).alias("x"), "token_count")
    state = None
    for i, term in enumerate(("easement", "mortgage", "zoning"), 1):
        hits = rows.filter(F.col("x").contains(term))
        hits = hits if state is None else hits.join(F.broadcast(state.select("id")), "id", "left_anti")
        new = hits.orderBy(F.desc_nulls_last("token_count"), "id").limit(10).select("id", F.lit(i).alias("round"))
        state = new if state is None else state.unionByName(new)
    return state


TRI = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@book.add(f"""WITH v AS (SELECT DISTINCT lower(trim(matched_alias)) AS v FROM canada_case_law_links WHERE trim(matched_alias) <> ''), g AS (SELECT v, {TRI.format('v')} AS a, {TRI.format("'cold storage apprenticeship'")} AS q FROM v)
    SELECT v AS value, round(len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))), 6) AS similarity FROM g WHERE len(a) > 0 AND len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) >= 0.3 ORDER BY similarity DESC, value LIMIT 20""")
def r42_similar_runs(t: Tables) -> DataFrame:
    v = t.canada_case_law_links.select(F.lower(F.trim("matched_alias")).alias("value")).filter("value <> ''").distinct()
    s = V.jaccard(X.trigrams(F.col("value")), X.trigrams(F.lit("cold storage apprenticeship")))
    return v.select("value", s.alias("s")).filter("s >= 0.3").select("value", F.round("s", 6).alias("similarity")).orderBy(F.desc("similarity"), "value").limit(20)


@book.add("""WITH l AS (SELECT case_item_id AS c, list_sort(list_distinct(list(law_id))) AS g FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1), p AS (SELECT a.c AS a, b.c AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS j FROM l a JOIN l b ON a.c < b.c WHERE len(list_intersect(a.g, b.g)) > 0)
    SELECT a, b, round(0.3 + 0.42 * j, 6)::DOUBLE AS similarity FROM p WHERE 0.3 + 0.42 * j >= 0.6""")
def r43_history_pairs(t: Tables) -> DataFrame:
    least = (0.6 - 0.3) / 0.42 - 1e-9
    both = R.similar_sets(t.canada_case_law_links, "case_item_id", "law_id", least).withColumnRenamed("common", "c")
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return both.select("a", "b", (0.3 + 0.42 * j).alias("s")).filter("s >= 0.6").select("a", "b", F.round("s", 6).alias("similarity"))


@book.add("""WITH q AS (SELECT case_item_id AS q, list(law_id ORDER BY match_score DESC NULLS LAST, id) AS got FROM (SELECT case_item_id, law_id, max(match_score) AS match_score, min(id) AS id FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT q, got, list_filter(got, lambda x: x % 2 = 0) AS rel FROM q) SELECT q, round(CASE WHEN len(rel) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, 6), lambda i: CASE WHEN list_contains(rel, got[i]) THEN 1 / log2(i + 1) ELSE 0 END)), 0)
    / list_sum(list_transform(range(1, least(len(rel), len(got), 5) + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg FROM r""")
def f28_ndcg(t: Tables) -> DataFrame:
    k = t.canada_case_law_links.filter("law_id is not null").groupBy("case_item_id", "law_id").agg(F.max("match_score").alias("m"), F.min("id").alias("i"))
    order = F.array_sort(F.collect_list(F.struct(F.negative(F.coalesce("m", F.lit(-1.0))).alias("a"), F.col("i").alias("b"), "law_id")))
    rows = k.groupBy(F.col("case_item_id").alias("q")).agg(F.transform(order, lambda x: x["law_id"]).alias("got")).withColumn("rel", F.filter("got", lambda x: x % 2 == 0))
    return rows.select("q", F.round(V.ndcg_at(F.col("rel"), F.col("got"), 5), 6).alias("ndcg"))


@book.add()
def f29_role_repetition(t: Tables) -> DataFrame:
    """For each event its most similar earlier event of the same user within two places, from .86."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    text = F.concat_ws(" ", "event_type", F.round("value", 0).cast("string"))
    rows = t.events.select("user_id", "event_id", text.alias("x")).withColumn("b1", F.lag("x", 1).over(w)).withColumn("b2", F.lag("x", 2).over(w))
    s = F.greatest(X.sequence_ratio("x", F.coalesce("b1", F.lit(""))), X.sequence_ratio("x", F.coalesce("b2", F.lit(""))))
    return rows.select("user_id", "event_id", F.round(s, 4).alias("similarity")).filter("similarity >= 0.86")


@book.add("""SELECT case_item_id, CASE WHEN count(law_id) >= 3 AND max(match_score) >= 0.9 THEN 'supported' WHEN count(law_id) >= 1 THEN 'partial' WHEN count(*) >= 5 THEN 'unverified' ELSE 'thin' END AS verdict FROM canada_case_law_links GROUP BY 1""")
def f30_evidence_verdict(t: Tables) -> DataFrame:
    g = t.canada_case_law_links.groupBy("case_item_id").agg(F.count("law_id").alias("laws"), F.max("match_score").alias("best"), F.count(F.lit(1)).alias("n"))
    v = F.when((F.col("laws") >= 3) & (F.col("best") >= 0.9), "supported").when(F.col("laws") >= 1, "partial").when(F.col("n") >= 5, "unverified").otherwise("thin")
    return g.select("case_item_id", v.alias("verdict"))


@book.add("SELECT k.id AS link_id, s.title, round(k.match_score, 4) AS score FROM canada_case_law_links k JOIN source_items s ON s.id = k.case_item_id WHERE k.law_id = (SELECT law_id FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, law_id LIMIT 1)")
def k03_rule_detail(t: Tables) -> DataFrame:
    k = t.canada_case_law_links.filter("law_id is not null")
    top = k.groupBy("law_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "law_id").limit(1).select("law_id")
    mine = k.select(F.col("id").alias("link_id"), "case_item_id", "law_id", "match_score").join(F.broadcast(top), "law_id", "left_semi")
    return mine.join(t.source_items.select(F.col("id").alias("case_item_id"), "title"), "case_item_id").select("link_id", "title", F.round("match_score", 4).alias("score"))


@book.add("""WITH l AS (SELECT law_id, count(*) AS n FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, law_id LIMIT 8), c AS (SELECT DISTINCT k.law_id, k.case_item_id FROM canada_case_law_links k JOIN l ON l.law_id = k.law_id)
    SELECT law_id, case_item_id FROM c QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY case_item_id) <= 4""")
def k05_fast_packet(t: Tables) -> DataFrame:
    k = t.canada_case_law_links.filter("law_id is not null")
    top = k.groupBy("law_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "law_id").limit(8).select("law_id")
    pairs = k.select("law_id", "case_item_id").join(F.broadcast(top), "law_id", "left_semi").distinct()
    return R.first_per_group(pairs, ["law_id"], ["case_item_id"], 4)


@book.add("""SELECT m AS mention, count(*) AS n, min(id) AS sample FROM (SELECT id, unnest(regexp_extract_all(coalesce(title, ''), '[A-Z][a-z]+ [A-Z][a-z]+ (?:Order|Schedule|Regulation|Act)')) AS m FROM rag_chunks) GROUP BY 1""")
def k08_law_mentions(t: Tables) -> DataFrame:
    m = t.rag_chunks.select("id", F.explode(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("[A-Z][a-z]+ [A-Z][a-z]+ (?:Order|Schedule|Regulation|Act)"), F.lit(0))).alias("mention"))
    return m.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample"))


@book.add("SELECT n_name AS program, count(c_custkey) AS entities, CAST(sum(length(c_name)) AS BIGINT) AS alias_chars FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def k09_sanctions_packet(t: Tables) -> DataFrame:
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.length("c_name")).alias("alias_chars"))
    return t.nation.select("n_nationkey", F.col("n_name").alias("program")).join(per, "n_nationkey", "left").select("program", F.coalesce("entities", F.lit(0)).alias("entities"), "alias_chars")


@book.add("""WITH r AS (SELECT k.law_id, k.case_item_id, max(coalesce(match_score, 0)) AS m FROM canada_case_law_links k WHERE law_id IS NOT NULL GROUP BY 1, 2), c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY m DESC, case_item_id) <= 3),
    l AS (SELECT law_id FROM r GROUP BY 1 ORDER BY count(*) DESC, law_id LIMIT 4) SELECT c.law_id, c.case_item_id, s.source_uid FROM c JOIN l ON l.law_id = c.law_id LEFT JOIN source_items s ON s.id = c.case_item_id""")
def k11_supporting_groups(t: Tables) -> DataFrame:
    r = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id", "case_item_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("m"))
    laws = r.groupBy("law_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "law_id").limit(4).select("law_id")
    mine = R.first_per_group(r.join(F.broadcast(laws), "law_id", "left_semi"), ["law_id"], [F.desc("m"), "case_item_id"], 3)
    return mine.join(t.source_items.select(F.col("id").alias("case_item_id"), "source_uid"), "case_item_id", "left").select("law_id", "case_item_id", "source_uid")


@book.add("""WITH h AS (SELECT doc_id, coalesce(n_chars, 0) AS v, sha256(lower(trim(text)) || '|' || coalesce(source, '')) AS k FROM documents WHERE text IS NOT NULL)
    SELECT min(doc_id) AS first_id, max(doc_id) AS kept_id, count(*) AS merged, CAST(sum(v) AS BIGINT) AS total FROM h GROUP BY k""")
def k19_history_upsert(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.lower(F.trim("text")), F.coalesce("source", F.lit(""))), 256)
    return t.documents.filter("text is not null").groupBy(key.alias("k")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("merged"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("total")).drop("k")


@book.add("""WITH s AS (SELECT id, source_code, source_uid, item_url, updated_at FROM source_items), c AS (SELECT id, coalesce((SELECT max(b.id) FROM s b WHERE b.item_url = a.item_url AND b.id <= a.id), id) AS identity FROM s a) SELECT identity, count(*) AS versions, max(id) AS newest FROM c GROUP BY 1""")
def k21_curated_identity(t: Tables) -> DataFrame:
    ids = t.source_items.select("id", "item_url")
    w = Window.partitionBy("item_url").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    known = ids.withColumn("identity", F.when(F.col("item_url").isNotNull(), F.max("id").over(w)).otherwise(F.col("id")))
    return known.groupBy("identity").agg(F.count(F.lit(1)).alias("versions"), F.max("id").alias("newest"))


@book.add("SELECT id, sha256(substr(coalesce(raw_text, ''), 1, 4000)) AS snapshot, CASE WHEN regexp_matches(coalesce(raw_text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') THEN 'redacted' ELSE 'plain' END AS state FROM source_items WHERE coalesce(source_code, '') <> ''")
def k24_evidence_snapshots(t: Tables) -> DataFrame:
    body = F.substring(F.coalesce("raw_text", F.lit("")), 1, 4000)
    state = F.when(F.coalesce("raw_text", F.lit("")).rlike(X.EMAIL), "redacted").otherwise("plain")
    return t.source_items.filter("coalesce(source_code, '') <> ''").select("id", F.sha2(body, 256).alias("snapshot"), state.alias("state"))


@book.add(f"""WITH r AS (SELECT id, coalesce(raw_text, '') AS x, regexp_replace(regexp_replace(coalesce(raw_text, ''), '{X.EMAIL}', '[email]', 'g'), '{X.PHONE}', '[phone]', 'g') AS y FROM source_items WHERE coalesce(source_code, '') <> '')
    SELECT id, sha256(y) AS snapshot, CASE WHEN x <> y THEN 'redacted' ELSE 'plain' END AS state FROM r""")
def k24_whole_snapshots(t: Tables) -> DataFrame:
    return E.snapshots(t.source_items.filter("coalesce(source_code, '') <> ''").select("id", "source_uid", "raw_text"), "source_items")


@book.add("SELECT id, '[' || coalesce(nullif(trim(title), ''), 'untitled') || '](' || source_url || '#chunk-' || chunk_index || ')' AS link FROM rag_chunks WHERE source_url IS NOT NULL AND chunk_index IS NOT NULL")
def k25_citation_links(t: Tables) -> DataFrame:
    link = F.concat(F.lit("["), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")), F.lit("]("), "source_url", F.lit("#chunk-"), F.col("chunk_index").cast("string"), F.lit(")"))
    return t.rag_chunks.filter("source_url is not null and chunk_index is not null").select("id", link.alias("link"))


@book.add("""SELECT CASE WHEN source_table = 'canada_laws' THEN 'legislation' ELSE 'case' END AS card, count(*) AS n, min(CASE WHEN source_table = 'canada_laws' THEN coalesce(citation, '') ELSE coalesce(court_level, '') END) AS first_label FROM rag_chunks WHERE chunk_index = 0 GROUP BY 1""")
def k26_result_cards(t: Tables) -> DataFrame:
    law = F.col("source_table") == "canada_laws"
    card = F.when(law, F.struct(F.lit("legislation").alias("card"), F.coalesce("citation", F.lit("")).alias("label"))).otherwise(F.struct(F.lit("case").alias("card"), F.coalesce("court_level", F.lit("")).alias("label")))
    rows = t.rag_chunks.filter("chunk_index = 0").select(card.alias("c"))
    return rows.groupBy(F.col("c.card").alias("card")).agg(F.count(F.lit(1)).alias("n"), F.min("c.label").alias("first_label"))


@book.add("""WITH d AS (SELECT user_id, event_type, arg_max(value, event_id) AS last_value, count(*) AS seen FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS observed, CAST(sum(seen) AS BIGINT) AS events, round(max(last_value), 4) AS top FROM d GROUP BY 1""")
def k27_preference_upserts(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.count(F.lit(1)).alias("seen"))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("observed"), F.sum("seen").alias("events"), F.round(F.max("last_value"), 4).alias("top"))


@book.add("""WITH r AS (SELECT o_orderkey AS changeset, count(DISTINCT l_suppkey) AS vendors, count(*) AS reviews, bool_and(l_returnflag <> 'R') AS approved FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT changeset, CASE WHEN NOT approved THEN 'rejected' WHEN vendors < 2 THEN 'draft' WHEN reviews < 4 THEN 'staged' ELSE 'active' END AS state FROM r""")
def k29_release_gates(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("changeset")).agg(F.countDistinct("l_suppkey").alias("vendors"), F.count(F.lit(1)).alias("reviews"), F.bool_and(F.col("l_returnflag") != "R").alias("approved"))
    known = r.join(t.orders.select(F.col("o_orderkey").alias("changeset")), "changeset", "left_semi")
    state = F.when(~F.col("approved"), "rejected").when(F.col("vendors") < 2, "draft").when(F.col("reviews") < 4, "staged").otherwise("active")
    return known.select("changeset", state.alias("state"))


@book.add("SELECT law_level, law_kind, count(*) AS n FROM canada_laws GROUP BY 1, 2")
def k30_corpus_stats(t: Tables) -> DataFrame:
    return t.canada_laws.groupBy("law_level", "law_kind").agg(F.count(F.lit(1)).alias("n"))


@book.add("""WITH l AS (SELECT user_id, max(epoch_us(ts)) AS last, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1), n AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT user_id, state FROM l, n WHERE NOT (state IN ('purchase', 'error') AND now - last > 7200000000)""")
def x02_expired_runs(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    l = t.events.groupBy("user_id").agg(F.max(micros).alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    now = t.events.agg(F.max(micros).alias("now"))
    rows = l.join(F.broadcast(now), F.lit(True))
    return rows.filter(~(F.col("state").isin("purchase", "error") & (F.col("now") - F.col("last") > 7_200_000_000))).select("user_id", "state")


@book.add("""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events), q AS (SELECT e.event_id, CASE WHEN event_type = 'click' AND n.now - epoch_us(ts) > 900000000 THEN 'queued' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'signup' THEN 'queued' ELSE 'done' END AS state, ts FROM events e, n)
    SELECT event_id, CASE WHEN state = 'queued' AND row_number() OVER (PARTITION BY state ORDER BY ts, event_id) <= 10 THEN 'claimed' ELSE state END AS state FROM q""")
def x05_queue_transition(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    now = t.events.agg(F.max(micros).alias("now"))
    q = t.events.select("event_id", "event_type", "ts", micros.alias("m")).join(F.broadcast(now), F.lit(True))
    click, stale = F.col("event_type") == "click", F.col("now") - F.col("m") > 900_000_000
    q = q.withColumn("state", F.when(click & stale, "queued").when(click, "running").when(F.col("event_type") == "signup", "queued").otherwise("done"))
    # the ten oldest are found by a bounded sort, not by ranking the whole queue
    claimed = q.filter("state = 'queued'").orderBy("ts", "event_id").limit(10).select("event_id", F.lit("claimed").alias("c"))
    return q.select("event_id", "state").join(F.broadcast(claimed), "event_id", "left").select("event_id", F.coalesce("c", "state").alias("state"))
