"""Nested results, links, evidence and the upkeep of tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import arrays as V
from docketry.operators import chunking as C
from docketry.operators import relational as R
from docketry.operators import relevance as S
from docketry.plans.book import Book, Tables
from docketry.runtime import checkpoint_dir

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


@book.add()
def c01_chunks(t: Tables) -> DataFrame:
    return C.chunk_documents(t.source_items, "id", "raw_text", "title")


@book.add()
def f22_entities(t: Tables) -> DataFrame:
    rows = t.source_items.filter("raw_text is not null").select("id", F.explode(C.entities("raw_text")).alias("e"))
    return rows.select("id", "e.entity_type", "e.name", "e.start", "e.confidence")


@book.add("""WITH a AS (SELECT k.id, k.case_item_id, k.law_id, l.origin = 'official' AS official, CASE WHEN lower(trim(k.matched_alias)) = lower(l.title) THEN 'title' WHEN trim(k.matched_alias) = l.citation THEN 'citation' ELSE 'alias' END AS how
    FROM canada_case_law_links k JOIN canada_laws l ON l.id = k.law_id WHERE trim(k.matched_alias) <> ''), g AS (SELECT case_item_id, law_id, official, how, count(*) AS n FROM a GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, round(least(CASE how WHEN 'title' THEN CASE WHEN official THEN 0.97 ELSE 0.88 END WHEN 'citation' THEN 0.95 ELSE CASE WHEN official THEN 0.92 ELSE 0.83 END END + least(0.03, 0.01 * (n - 1)), 0.99)::DOUBLE, 4) AS score FROM g)
    SELECT case_item_id, law_id, max(score) AS score FROM s GROUP BY 1, 2""")
def r34_alias_links(t: Tables) -> DataFrame:
    laws = t.canada_laws.select(F.col("id").alias("law_id"), (F.col("origin") == "official").alias("official"), F.lower("title").alias("title"), "citation")
    rows = t.canada_case_law_links.filter("trim(matched_alias) <> '' and law_id is not null").select("case_item_id", "law_id", F.trim("matched_alias").alias("v")).join(laws, "law_id")
    how = F.when(F.lower("v") == F.col("title"), "title").when(F.col("v") == F.col("citation"), "citation").otherwise("alias")
    g = rows.groupBy("case_item_id", "law_id", "official", how.alias("how")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("case_item_id", "law_id").agg(F.max(S.link_score(F.col("official"), F.col("how"), F.col("n"))).alias("score"))


@book.add("""WITH r AS (SELECT id, lower(coalesce(evidence_excerpt, '')) AS x, coalesce(matched_alias, '') AS a FROM canada_case_law_links), k AS (SELECT *, CASE
    WHEN x LIKE '%applied%' OR x LIKE '%applying%' OR x LIKE '%applies%' THEN 'applied' WHEN x LIKE '%interpreted%' OR x LIKE '%explained%' OR x LIKE '%described%' THEN 'explained'
    WHEN x LIKE '%distinguished%' OR x LIKE '%contrary to%' THEN 'distinguished' WHEN x LIKE '%pursuant to%' OR x LIKE '%cited%' OR x LIKE '%under%' OR x LIKE '%relied on%' THEN 'cited' ELSE 'related' END AS kind FROM r)
    SELECT id, kind, round(least(CASE kind WHEN 'cited' THEN 1.0 WHEN 'applied' THEN 0.9 WHEN 'explained' THEN 0.8 WHEN 'distinguished' THEN 0.7 ELSE 0.6 END + CASE WHEN length(a) > 20 THEN 0.05 ELSE 0 END + CASE WHEN length(a) > 40 THEN 0.05 ELSE 0 END, 1.0)::DOUBLE, 4) AS score FROM k""")
def r35_reference_relations(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.select("id", S.relation_type(F.col("evidence_excerpt")).alias("kind"), F.coalesce("matched_alias", F.lit("")).alias("a"))
    return rows.select("id", "kind", S.relation_score(F.col("kind"), F.col("a")).alias("score"))


def _field_sql(c: str, w: float, terms: dict[str, float]) -> str:
    low = f"lower(substr(coalesce({c}, ''), 1, 2200))"
    n = "((length({0}) - length(replace({0}, '{1}', ''))) / {2}.0::DOUBLE)"
    return " + ".join(f"CASE WHEN {n.format(low, x, len(x))} > 0 THEN {w}::DOUBLE * {v}::DOUBLE * (1 + ln(1 + least({n.format(low, x, len(x))}, 4.0::DOUBLE))) / greatest(1.0::DOUBLE, sqrt(greatest(80, length({low})) / 420.0::DOUBLE)) ELSE 0.0::DOUBLE END" for x, v in terms.items())


RANK_TERMS = {"lease": 1.7, "easement": 1.7, "tenant": 1.0}


@book.add(f"""WITH s AS (SELECT id, {_field_sql('title', 3.2, RANK_TERMS)} + {_field_sql('raw_text', 1.4, RANK_TERMS)} AS c FROM source_items)
    SELECT id, round(0.44 * least(greatest(ln(1 + c) / ln(19.0::DOUBLE), 0), 1) + 0.05, 4)::DOUBLE AS rank FROM s WHERE c > 0""")
def r36_relation_rank(t: Tables) -> DataFrame:
    c = S.weighted_terms([(F.col("title"), 3.2), (F.col("raw_text"), 1.4)], RANK_TERMS, prefix=2200)
    return t.source_items.select("id", c.alias("c")).filter("c > 0").select("id", F.round(0.44 * S.normalised(F.col("c"), 18) + 0.05, 4).alias("rank"))


def _whole_field_sql(c: str, w: float, terms: dict[str, float]) -> str:
    low = f"lower(coalesce({c}, ''))"
    parts = []
    for x, v in terms.items():
        n = f"((length({low}) - length(replace({low}, '{x}', ''))) / {len(x)}.0::DOUBLE)"
        parts.append(f"CASE WHEN {n} > 0 THEN {w}::DOUBLE * {v}::DOUBLE * (1 + ln(1 + least({n}, 4.0::DOUBLE))) / greatest(1.0::DOUBLE, sqrt(greatest(80, length({low})) / 420.0::DOUBLE)) ELSE 0.0::DOUBLE END")
    return " + ".join(parts)


@book.add(f"""WITH s AS (SELECT id, {_whole_field_sql('title', 3.2, RANK_TERMS)} + {_whole_field_sql('raw_text', 1.4, RANK_TERMS)} AS c FROM source_items)
    SELECT id, round(0.44 * least(greatest(ln(1 + c) / ln(19.0::DOUBLE), 0), 1) + 0.05, 4)::DOUBLE AS rank FROM s WHERE c > 0""")
def r36_whole_relation_rank(t: Tables) -> DataFrame:
    c = S.weighted_terms([(F.col("title"), 3.2), (F.col("raw_text"), 1.4)], RANK_TERMS)
    return t.source_items.select("id", c.alias("c")).filter("c > 0").select("id", F.round(0.44 * S.normalised(F.col("c"), 18) + 0.05, 4).alias("rank"))


@book.add("""WITH h AS (SELECT k.id, k.law_id, coalesce(k.match_score, 0) AS m, lower(coalesce(s.title, '')) LIKE '%order%' AS th, lower(coalesce(s.raw_text, '')) LIKE '%lease%' AS bh, coalesce(trim(s.item_url), '') <> '' AS src
    FROM canada_case_law_links k JOIN source_items s ON s.id = k.case_item_id), r AS (SELECT *, 0.05 + CASE WHEN law_id IS NOT NULL THEN 0.1 ELSE 0 END + m * CASE WHEN law_id IS NULL THEN 0.16 ELSE 0.22 END + th::INT * 0.04 + bh::INT * 0.055 + src::INT * 0.025 AS x FROM h)
    SELECT id, round(least(greatest(x, 0.05), least(0.82, CASE WHEN law_id IS NULL THEN 0.48 ELSE 1 END, CASE WHEN NOT th AND NOT bh THEN 0.36 ELSE 1 END, CASE WHEN th <> bh THEN 0.52 ELSE 1 END, CASE WHEN NOT src THEN 0.68 ELSE 1 END))::DOUBLE, 4) AS relevance FROM r""")
def r37_capped_relevance(t: Tables) -> DataFrame:
    items = t.source_items.select(F.col("id").alias("case_item_id"), F.lower(F.coalesce("title", F.lit(""))).contains("order").alias("th"), F.lower(F.coalesce("raw_text", F.lit(""))).contains("lease").alias("bh"), (F.trim(F.coalesce("item_url", F.lit(""))) != "").alias("src"))
    rows = t.canada_case_law_links.select("id", "case_item_id", "law_id", F.coalesce("match_score", F.lit(0.0)).alias("m")).join(items, "case_item_id")
    has, th, bh, src = F.col("law_id").isNotNull(), F.col("th"), F.col("bh"), F.col("src")
    x = 0.05 + F.when(has, 0.1).otherwise(0.0) + F.col("m") * F.when(has, 0.22).otherwise(0.16) + th.cast("int") * 0.04 + bh.cast("int") * 0.055 + src.cast("int") * 0.025
    return rows.select("id", S.capped(x, [(F.lit(True), 0.82), (~has, 0.48), (~th & ~bh, 0.36), (th != bh, 0.52), (~src, 0.68)]).alias("relevance"))


@book.add("SELECT id, CAST(CASE WHEN lower(title) LIKE '%quota%' THEN 10 ELSE 0 END + CASE WHEN lower(title) LIKE '%act%' THEN 3 ELSE 0 END + CASE WHEN lower(coalesce(aliases_json, '')) LIKE '%quota%' THEN 5 ELSE 0 END AS INT) AS points FROM canada_laws WHERE lower(title) LIKE '%quota%' OR lower(title) LIKE '%act%'")
def r38_keyword_points(t: Tables) -> DataFrame:
    low = F.lower("title")
    p = F.when(low.contains("quota"), 10).otherwise(0) + F.when(low.contains("act"), 3).otherwise(0) + F.when(F.lower(F.coalesce("aliases_json", F.lit(""))).contains("quota"), 5).otherwise(0)
    return t.canada_laws.filter(low.contains("quota") | low.contains("act")).select("id", p.alias("points"))


@book.add("""WITH c AS (SELECT id, len(regexp_extract_all(coalesce(text_content, ''), 's\\. ?[0-9]+')) AS s, len(regexp_extract_all(coalesce(text_content, ''), '[A-Z][a-z]+ Act')) AS a, coalesce(token_count, 0) AS n FROM rag_chunks)
    SELECT id, round((0.68 * least(n / 500.0, 1) + 0.32 * (least(0.16, 0.04 * s) + least(0.25, 0.08 * a)))::DOUBLE, 4) AS score FROM c""".replace("\\\\", "\\"))
def r39_signal_rerank(t: Tables) -> DataFrame:
    x = F.coalesce("text_content", F.lit(""))
    s, a = F.regexp_count(x, F.lit(r"s\. ?[0-9]+")), F.regexp_count(x, F.lit("[A-Z][a-z]+ Act"))
    base = F.least(F.coalesce("token_count", F.lit(0)) / 500.0, F.lit(1.0))
    return t.rag_chunks.select("id", F.round(0.68 * base + 0.32 * (F.least(F.lit(0.16), 0.04 * s) + F.least(F.lit(0.25), 0.08 * a)), 4).alias("score"))


@book.add(r"""WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}'))) AS t FROM source_items), l AS (SELECT id AS law_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{4,}'))) AS t FROM canada_laws WHERE origin = 'official'),
    j AS (SELECT w.id, l.law_id, count(*) AS n FROM w JOIN l ON w.t = l.t GROUP BY 1, 2 HAVING count(*) >= 3) SELECT id, law_id, round(least(0.25, 0.05 * n) + 0.7 * 0.5 + 0.15 * 0.9, 6)::DOUBLE AS score FROM j""")
def r41_title_association(t: Tables) -> DataFrame:
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))).alias("t")
    w = t.source_items.select("id", words("title"))
    l = t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("law_id"), words("title"))
    j = R.sharing_sets(w, l, "id", "law_id", "t", 3).withColumnRenamed("common", "n")
    return j.select("id", "law_id", F.round(F.least(F.lit(0.25), 0.05 * F.col("n")) + 0.7 * 0.5 + 0.15 * 0.9, 6).alias("score"))


@book.add("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS c, avg(value) AS v FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN e % 5 >= 2 OR c % 7 >= 4 OR v / 50 < 0.35 THEN 'high' WHEN e % 5 = 1 OR c % 7 >= 2 OR v / 50 < 0.55 THEN 'medium' ELSE 'low' END AS level FROM u""")
def r44_risk_levels(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "click").alias("c"), F.avg("value").alias("v"))
    return u.select("user_id", S.risk_level(F.col("e") % 5, F.col("c") % 7, F.col("v") / 50).alias("level"))


@book.add("""WITH g AS (SELECT law_id, count(DISTINCT case_item_id) AS cases, avg(coalesce(match_score, 0)) AS m, avg((coalesce(trim(evidence_excerpt), '') <> '')::INT) AS ev, count(*) AS n FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1),
    q AS (SELECT *, round((0.24 * least(cases / 4.0, 1) + 0.3 * m + 0.28 * ev + 0.18 * least(n / 5.0, 1))::DOUBLE, 4) AS quality FROM g)
    SELECT law_id, quality, CASE WHEN quality >= 0.72 AND cases >= 2 THEN 'strong' WHEN quality >= 0.45 THEN 'moderate' ELSE 'thin' END AS status FROM q""")
def a23_evidence_quality(t: Tables) -> DataFrame:
    has = F.when(F.trim(F.coalesce("evidence_excerpt", F.lit(""))) != "", 1.0).otherwise(0.0)
    g = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id").agg(F.countDistinct("case_item_id").alias("cases"), F.avg(F.coalesce("match_score", F.lit(0.0))).alias("m"), F.avg(has).alias("ev"), F.count(F.lit(1)).alias("n"))
    q = F.round(0.24 * F.least(F.col("cases") / 4.0, F.lit(1.0)) + 0.3 * F.col("m") + 0.28 * F.col("ev") + 0.18 * F.least(F.col("n") / 5.0, F.lit(1.0)), 4)
    rows = g.withColumn("quality", q)
    return rows.select("law_id", "quality", F.when((F.col("quality") >= 0.72) & (F.col("cases") >= 2), "strong").when(F.col("quality") >= 0.45, "moderate").otherwise("thin").alias("status"))


@book.add("""WITH p AS (SELECT doc_id, CASE WHEN lower(coalesce(lang, '')) LIKE 'en%' THEN 'en' WHEN lower(coalesce(lang, '')) LIKE 'fr%' THEN 'fr' ELSE 'other' END AS gold, CASE WHEN regexp_matches(lower(text), '\\b(the|of)\\b') THEN 'en' WHEN regexp_matches(lower(text), '\\b(le|la|les)\\b') THEN 'fr' ELSE 'other' END AS guess FROM documents WHERE text IS NOT NULL),
    l AS (SELECT unnest(['en', 'fr', 'other']) AS label), c AS (SELECT label, count(*) FILTER (WHERE gold = label AND guess = label) AS tp, count(*) FILTER (WHERE gold <> label AND guess = label) AS fp, count(*) FILTER (WHERE gold = label AND guess <> label) AS fn FROM p, l GROUP BY 1)
    SELECT label, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""".replace("\\\\", "\\"))
def a26_label_metrics(t: Tables) -> DataFrame:
    low = F.lower(F.coalesce("lang", F.lit("")))
    gold = F.when(low.startswith("en"), "en").when(low.startswith("fr"), "fr").otherwise("other")
    body = F.lower("text")
    guess = F.when(body.rlike(r"\b(the|of)\b"), "en").when(body.rlike(r"\b(le|la|les)\b"), "fr").otherwise("other")
    # one small matrix of counts, from which all measures follow
    matrix = t.documents.filter("text is not null").groupBy(gold.alias("g"), guess.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = matrix.select("g", "p", "n", F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("other"))).alias("label")).groupBy("label")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = rows.agg(hit((F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), hit((F.col("g") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"), hit((F.col("g") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("label", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


ISSUES = ("lease", "easement", "mortgage", "zoning")


@book.add("""WITH i AS (SELECT unnest(['lease', 'easement', 'mortgage', 'zoning']) AS issue), e AS (SELECT i.issue, count(*) FILTER (WHERE c.source_table = 'canada_laws' AND lower(c.text_content) LIKE '%' || i.issue || '%') AS laws,
    count(*) FILTER (WHERE c.source_table = 'source_items' AND lower(c.text_content) LIKE '%' || i.issue || '%') AS cases FROM i, rag_chunks c GROUP BY 1)
    SELECT issue, laws, cases, CASE WHEN laws > 0 AND cases > 0 THEN 'covered' WHEN laws + cases > 0 THEN 'partial' ELSE 'missing' END AS status FROM e""")
def a27_issue_coverage(t: Tables) -> DataFrame:
    low, law = F.lower("text_content"), F.col("source_table") == "canada_laws"
    one = t.rag_chunks.agg(*[F.struct(F.lit(i).alias("issue"), F.count_if(law & low.contains(i)).alias("laws"), F.count_if(~law & low.contains(i)).alias("cases")).alias(i) for i in ISSUES])
    rows = one.select(F.explode(F.array(*[F.col(i) for i in ISSUES])).alias("r")).select("r.*")
    return rows.withColumn("status", F.when((F.col("laws") > 0) & (F.col("cases") > 0), "covered").when(F.col("laws") + F.col("cases") > 0, "partial").otherwise("missing"))


@book.add("""WITH r AS (SELECT k.law_id, k.case_item_id, max(coalesce(k.match_score, 0)) AS m FROM canada_case_law_links k WHERE k.law_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT law_id, count(*) AS cases, round(max(m), 4) AS best,
    string_agg(case_item_id::VARCHAR, ',' ORDER BY m DESC, case_item_id) AS ids FROM r GROUP BY 1) SELECT l.id AS law_id, l.title, g.cases, g.best, g.ids FROM g JOIN canada_laws l ON l.id = g.law_id""")
def k01_case_rule_packet(t: Tables) -> DataFrame:
    r = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id", "case_item_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("m"))
    nested = F.array_sort(F.collect_list(F.struct(F.negative("m").alias("a"), F.col("case_item_id").alias("b"))))
    g = r.groupBy("law_id").agg(F.count(F.lit(1)).alias("cases"), F.round(F.max("m"), 4).alias("best"), F.array_join(F.transform(nested, lambda x: x["b"].cast("string")), ",").alias("ids"))
    return g.join(t.canada_laws.select(F.col("id").alias("law_id"), "title"), "law_id").select("law_id", "title", "cases", "best", "ids")


@book.add("""WITH a AS (SELECT id, jurisdiction, lower(regexp_replace(title, ', [0-9]{4}$', '')) AS t FROM canada_laws WHERE length(title) >= 6), b AS (SELECT id, jurisdiction, lower(title) AS t FROM canada_laws WHERE length(title) >= 6)
    SELECT a.id AS left_id, b.id AS right_id, 0.75::DOUBLE AS score FROM a JOIN b ON a.jurisdiction = b.jurisdiction AND a.id <> b.id AND (contains(a.t, b.t) OR contains(b.t, a.t))""")
def k04_containment_links(t: Tables) -> DataFrame:
    rows = t.canada_laws.filter(F.length("title") >= 6).select("id", "jurisdiction", F.lower("title").alias("t"))
    a = rows.select(F.col("id").alias("left_id"), "jurisdiction", F.regexp_replace("t", ", [0-9]{4}$", "").alias("ta"))
    b = rows.select(F.col("id").alias("right_id"), "jurisdiction", F.col("t").alias("tb"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 3)), lambda i: F.substring(F.col(c), i, F.lit(4))))).alias("four")
    four = lambda c: F.substring(c, 1, 4).alias("four")
    # what contains a name has the name's first four letters at some place; names without their year have four or more
    one = a.select("*", grams("ta")).join(b.select("*", four("tb")), ["jurisdiction", "four"]).filter(F.contains("ta", "tb"))
    two = b.select("*", grams("tb")).join(a.select("*", four("ta")), ["jurisdiction", "four"]).filter(F.contains("tb", "ta"))
    both = one.select("left_id", "right_id").unionByName(two.select("left_id", "right_id")).filter("left_id <> right_id").distinct()
    return both.select("left_id", "right_id", F.lit(0.75).alias("score"))


@book.add("""WITH l AS (SELECT law_id, count(*) AS n FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1) SELECT c.id, c.origin, coalesce(l.n, 0) AS links FROM canada_laws c LEFT JOIN l ON l.law_id = c.id ORDER BY (c.origin = 'official') DESC, links DESC, c.title, c.id LIMIT 60""")
def k06_result_graph(t: Tables) -> DataFrame:
    l = t.canada_case_law_links.filter("law_id is not null").groupBy(F.col("law_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    rows = t.canada_laws.select("id", "origin", "title").join(l, "id", "left").fillna(0, ["links"])
    return rows.orderBy((F.col("origin") == "official").desc(), F.desc("links"), "title", "id").limit(60).select("id", "origin", "links")


@book.add(r"""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(aliases_json, '')), '[a-z]+')) AS b FROM canada_laws)
    SELECT id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6)::DOUBLE AS ratio FROM w""")
def k12_overlap_ratio(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return t.canada_laws.select("id", F.round(V.overlap_ratio(words("title"), words("aliases_json")), 6).alias("ratio"))


@book.add("""WITH c AS (SELECT case_item_id, count(*) AS facts, max((law_id IS NOT NULL)::INT) AS law, max((match_score >= 0.9)::INT) AS sure FROM canada_case_law_links GROUP BY 1)
    SELECT case_item_id, round((0.4 * least(facts / 3.0, 1) + 0.35 * law + 0.25 * coalesce(sure, 0))::DOUBLE, 4) AS strength FROM c""")
def k14_issue_strength(t: Tables) -> DataFrame:
    c = t.canada_case_law_links.groupBy("case_item_id").agg(F.count(F.lit(1)).alias("facts"), F.max(F.col("law_id").isNotNull().cast("int")).alias("law"), F.max((F.col("match_score") >= 0.9).cast("int")).alias("sure"))
    return c.select("case_item_id", F.round(0.4 * F.least(F.col("facts") / 3.0, F.lit(1.0)) + 0.35 * F.col("law") + 0.25 * F.coalesce("sure", F.lit(0)), 4).alias("strength"))


@book.add("""WITH c AS (SELECT case_item_id, avg(coalesce(match_score, 0)) AS m, avg((law_id IS NOT NULL)::INT) AS l FROM canada_case_law_links GROUP BY 1)
    SELECT case_item_id, round(1 / (1 + exp(-4 * (0.25 * m + 0.25 * l + 0.2 * least(m * 1.2, 1) + 0.15 * l + 0.15 * (1 - m) - 0.5))), 4) AS strength FROM c""")
def k15_case_strength(t: Tables) -> DataFrame:
    c = t.canada_case_law_links.groupBy("case_item_id").agg(F.avg(F.coalesce("match_score", F.lit(0.0))).alias("m"), F.avg(F.col("law_id").isNotNull().cast("int")).alias("l"))
    m, l = F.col("m"), F.col("l")
    return c.select("case_item_id", F.round(S.sigmoid(0.25 * m + 0.25 * l + 0.2 * F.least(m * 1.2, F.lit(1.0)) + 0.15 * l + 0.15 * (1 - m)), 4).alias("strength"))


@book.add("SELECT id, array_to_string(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(raw_text), '') = '' THEN 'text' END, CASE WHEN published_at IS NULL THEN 'date' END, CASE WHEN coalesce(trim(summary), '') = '' THEN 'summary' END], lambda x: x IS NOT NULL), ',') AS gaps FROM source_items")
def k16_gap_lists(t: Tables) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    gaps = F.array(F.when(blank("title"), "title"), F.when(blank("raw_text"), "text"), F.when(F.col("published_at").isNull(), "date"), F.when(blank("summary"), "summary"))
    return t.source_items.select("id", F.array_join(F.array_compact(gaps), ",").alias("gaps"))


@book.add("SELECT case_item_id, 'f' || substr(sha256(case_item_id || '|' || lower(trim(matched_alias))), 1, 12) AS fact_id, count(*) AS revision FROM canada_case_law_links WHERE trim(matched_alias) <> '' GROUP BY 1, 2")
def k17_packet_ids(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.filter("trim(matched_alias) <> ''")
    fact = F.concat(F.lit("f"), F.substring(F.sha2(F.concat_ws("|", F.col("case_item_id").cast("string"), F.lower(F.trim("matched_alias"))), 256), 1, 12))
    return rows.groupBy("case_item_id", fact.alias("fact_id")).agg(F.count(F.lit(1)).alias("revision"))


@book.add("""WITH f AS (SELECT id, generate_subscripts(a, 1) - 1 AS p, unnest(a) AS x FROM (SELECT id, string_split(lower(title), ' ') AS a FROM canada_laws)), n AS (SELECT id, len(list_distinct([jurisdiction, law_kind, origin])) AS k, list_sort(list_distinct([jurisdiction, law_kind, origin])) AS r FROM canada_laws)
    SELECT f.id, CAST(f.p AS INT) AS place, f.x AS word, n.r[CAST(f.p % n.k AS INT) + 1] AS rule FROM f JOIN n ON n.id = f.id""")
def k18_round_robin_edges(t: Tables) -> DataFrame:
    rules = F.array_sort(F.array_distinct(F.array("jurisdiction", "law_kind", "origin")))
    rows = t.canada_laws.select("id", rules.alias("r"), F.posexplode(F.split(F.lower("title"), " ")).alias("place", "word"))
    return rows.select("id", "place", "word", F.element_at("r", (F.col("place") % F.size("r")) + 1).alias("rule"))


@book.add("""SELECT id, coalesce(nullif(trim(summary), ''), substr(coalesce(raw_text, ''), 1, 80)) AS summary, coalesce(nullif(trim(source_code), ''), json_extract_string(raw_json, '$.kind'), 'unknown') AS code FROM source_items""")
def k20_repaired_rows(t: Tables) -> DataFrame:
    code = F.coalesce(F.nullif(F.trim("source_code"), F.lit("")), F.get_json_object("raw_json", "$.kind"), F.lit("unknown"))
    return t.source_items.select("id", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.substring(F.coalesce("raw_text", F.lit("")), 1, 80)).alias("summary"), code.alias("code"))


@book.add("""WITH a AS (SELECT s.*, rank() OVER (ORDER BY 1) FROM source_items s WHERE id % 2 = 0), n AS (SELECT * FROM source_items WHERE id % 3 = 0 AND source_code IS NOT NULL AND source_uid IS NOT NULL), b AS (SELECT source_code, source_uid, id, updated_at, 0 AS new FROM source_items WHERE id % 2 = 0 AND source_code IS NOT NULL AND source_uid IS NOT NULL
    UNION ALL SELECT source_code, source_uid, id, updated_at, 1 FROM n) SELECT source_code, source_uid, id FROM b QUALIFY row_number() OVER (PARTITION BY source_code, source_uid ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST, new DESC) = 1""")
def s16_upsert(t: Tables) -> DataFrame:
    rows = t.source_items.filter("source_code is not null and source_uid is not null").select("source_code", "source_uid", "id", "updated_at")
    return R.upsert(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0"), ["source_code", "source_uid"], ["updated_at", "id"]).drop("updated_at")


@book.add("SELECT id, title FROM canada_laws WHERE id % 2 = 0 UNION ALL SELECT id, title FROM canada_laws n WHERE n.id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM canada_laws o WHERE o.id % 2 = 0 AND o.id = n.id)")
def s17_insert_absent(t: Tables) -> DataFrame:
    rows = t.canada_laws.select("id", "title")
    return R.insert_absent(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0"), ["id"])


@book.add("""SELECT case_item_id, id, match_source FROM canada_case_law_links WHERE case_item_id NOT IN (SELECT case_item_id FROM canada_case_law_links WHERE id % 7 = 0 AND case_item_id IS NOT NULL)
    UNION ALL SELECT case_item_id, id, 'replaced' FROM canada_case_law_links WHERE id % 7 = 0""")
def s18_replace_children(t: Tables) -> DataFrame:
    rows = t.canada_case_law_links.select("case_item_id", "id", "match_source")
    return R.replace_children(rows, rows.filter("id % 7 = 0").withColumn("match_source", F.lit("replaced")), ["case_item_id"])


@book.add("SELECT c.id FROM rag_chunks c JOIN (SELECT source_table, source_id, count(*) AS n FROM rag_chunks GROUP BY 1, 2) m USING (source_table, source_id) WHERE c.chunk_index < m.n")
def s19_trailing_trim(t: Tables) -> DataFrame:
    made = t.rag_chunks.groupBy("source_table", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return t.rag_chunks.select("id", "source_table", "source_id", "chunk_index").join(made, ["source_table", "source_id"]).filter("chunk_index < n").select("id")


@book.add("SELECT k.id FROM canada_case_law_links k WHERE NOT (k.law_id IN (SELECT id FROM canada_laws WHERE origin = 'official') AND k.match_score < 0.5) OR k.law_id IS NULL OR k.match_score IS NULL")
def s20_delete_using(t: Tables) -> DataFrame:
    gone = t.canada_case_law_links.filter("match_score < 0.5").select("id", "law_id").join(t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("law_id")), "law_id", "left_semi")
    return t.canada_case_law_links.select("id").join(gone.select("id"), "id", "left_anti")


@book.add("SELECT id, origin FROM canada_laws WHERE origin <> 'inferred' OR id IN (SELECT law_id FROM canada_case_law_links WHERE law_id IS NOT NULL)")
def s21_prune_orphans(t: Tables) -> DataFrame:
    used = t.canada_case_law_links.filter("law_id is not null").select(F.col("law_id").alias("id")).distinct()
    orphans = t.canada_laws.filter("origin = 'inferred'").select("id").join(used, "id", "left_anti")
    return t.canada_laws.select("id", "origin").join(orphans, "id", "left_anti")


@book.add("SELECT 'item' AS src, id, title FROM source_items WHERE coalesce(trim(raw_text), '') <> '' UNION ALL SELECT 'law', id, title FROM canada_laws WHERE origin = 'official' UNION ALL SELECT 'chunk', id, title FROM rag_chunks WHERE chunk_index = 0 UNION ALL SELECT 'document', doc_id, docket FROM documents WHERE text IS NOT NULL")
def s14_document_union(t: Tables) -> DataFrame:
    part = lambda name, rows, key, title: rows.select(F.lit(name).alias("src"), F.col(key).alias("id"), F.col(title).alias("title"))
    a = part("item", t.source_items.filter("coalesce(trim(raw_text), '') <> ''"), "id", "title")
    b = part("law", t.canada_laws.filter("origin = 'official'"), "id", "title")
    c = part("chunk", t.rag_chunks.filter("chunk_index = 0"), "id", "title")
    d = part("document", t.documents.filter("text is not null"), "doc_id", "docket")
    return a.unionByName(b).unionByName(c).unionByName(d)


@book.add("SELECT id, source_uid FROM source_items WHERE id > 300 ORDER BY id LIMIT 100")
def s15_keyset_page(t: Tables) -> DataFrame:
    return t.source_items.filter("id > 300").orderBy("id").limit(100).select("id", "source_uid")


@book.add("SELECT chunk_id FROM rag_chunk_embeddings WHERE chunk_id % 10 = 3")
def s22_repeatable_sample(t: Tables) -> DataFrame:
    return t.rag_chunk_embeddings.filter("chunk_id % 10 = 3").select("chunk_id")


@book.add("""SELECT c_nationkey AS ent_num, count(*) AS aliases, string_agg(c_name, '; ' ORDER BY c_custkey) AS names, max(CASE WHEN c_mktsegment = '-0-' THEN '' ELSE c_mktsegment END) AS segment FROM customer GROUP BY 1""")
def s04_sanctions_assembly(t: Tables) -> DataFrame:
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "; ")
    clean = F.when(F.col("c_mktsegment") == "-0-", "").otherwise(F.col("c_mktsegment"))
    return t.customer.groupBy(F.col("c_nationkey").alias("ent_num")).agg(F.count(F.lit(1)).alias("aliases"), names.alias("names"), F.max(clean).alias("segment"))


@book.add("SELECT p_partkey, p_name FROM part WHERE p_size > 10")
def s03_csv_round_trip(t: Tables) -> DataFrame:
    folder = f"{checkpoint_dir(t.spark)}/csv-{Path(t.sf_dir).name}"
    t.part.filter("p_size > 10").select("p_partkey", "p_name").write.mode("overwrite").option("header", True).csv(folder)
    return t.spark.read.schema("p_partkey bigint, p_name string").option("header", True).csv(folder)


@book.add("SELECT id, title, jurisdiction FROM canada_laws WHERE jurisdiction IS NOT NULL")
def s11_json_archive(t: Tables) -> DataFrame:
    folder = f"{checkpoint_dir(t.spark)}/archive-{Path(t.sf_dir).name}"
    t.canada_laws.filter("jurisdiction is not null").select("id", "title", "jurisdiction").write.mode("overwrite").partitionBy("jurisdiction").json(folder)
    return t.spark.read.schema("id bigint, title string, jurisdiction string").json(folder)


@book.add("SELECT id, title FROM canada_laws WHERE origin = 'official'")
def s09_xml_items(t: Tables) -> DataFrame:
    folder = f"{checkpoint_dir(t.spark)}/xml-{Path(t.sf_dir).name}"
    t.canada_laws.filter("origin = 'official'").select("id", "title").write.mode("overwrite").format("xml").option("rowTag", "item").option("rootTag", "channel").save(folder)
    return t.spark.read.format("xml").option("rowTag", "item").schema("id bigint, title string").load(folder)


@book.add("""WITH a AS (SELECT source_code, regexp_extract(item_url, '[^/]+$', 0) AS leaf, item_url, id FROM source_items WHERE item_url LIKE 'https://%') SELECT item_url AS url, leaf, id FROM a QUALIFY row_number() OVER (PARTITION BY item_url ORDER BY id) = 1""")
def s08_link_index(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<li><a href=\""), "item_url", F.lit("\">"), F.coalesce("title", F.lit("")), F.lit("</a></li>"))
    links = t.source_items.select("id", F.explode(F.regexp_extract_all(page, F.lit("href=\"(https://[^\"]+)\""), F.lit(1))).alias("url"))
    return R.first_per_group(links, ["url"], ["id"]).select("url", F.regexp_extract("url", "[^/]+$", 0).alias("leaf"), "id")


@book.add("SELECT user_id, CAST(max(task_no) AS BIGINT) AS tasks FROM (SELECT user_id, sum((gap IS NULL OR gap > 900000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS task_no FROM (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1")
def x06_cooldown_tasks(t: Tables) -> DataFrame:
    return R.cooldown_sessions(t.events, ["user_id"], "ts", "event_id", 900).groupBy("user_id").agg(F.max("task_no").alias("tasks"))


@book.add("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events QUALIFY seq > 3")
def x01_replay_after(t: Tables) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", seq.alias("seq")).filter("seq > 3")


@book.add("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def x04_idempotent_submissions(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@book.add("""SELECT item_url AS url, 1.0::DOUBLE AS score FROM (SELECT DISTINCT item_url FROM source_items WHERE id % 2 = 0) UNION ALL SELECT DISTINCT source_url, 0.5::DOUBLE FROM rag_chunks WHERE source_url IS NOT NULL AND rtrim(source_url, '/') NOT IN (SELECT rtrim(item_url, '/') FROM source_items WHERE id % 2 = 0 AND item_url IS NOT NULL)""")
def x09_local_and_remote(t: Tables) -> DataFrame:
    local = t.source_items.filter("id % 2 = 0").select(F.col("item_url").alias("url")).distinct()
    key = F.regexp_replace("url", "/+$", "").alias("k")
    remote = t.rag_chunks.filter("source_url is not null").select(F.col("source_url").alias("url")).distinct().withColumn("k", F.regexp_replace("url", "/+$", ""))
    new = remote.join(local.select(key), "k", "left_anti").select("url", F.lit(0.5).alias("score"))
    return local.select("url", F.lit(1.0).alias("score")).unionByName(new)
