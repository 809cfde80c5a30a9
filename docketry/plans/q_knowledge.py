"""Dictionaries over columns, the knowledge graph with entities and concepts, and the packets made of laws and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import planner as P
from docketry.operators import graph as G
from docketry.operators import relational as R
from docketry.plans.book import Book, Tables

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _translated_sql() -> str:
    """The glossary applied term by term, each step on what the one before left."""
    steps = ["s0 AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, []::VARCHAR[] AS f FROM documents)"]
    for a, b in sorted(P.GLOSSARY.items(), key=lambda x: (-len(x[0]), x[0])):
        hit, n = f"contains(x, '{a}') AND len(f) < 12", len(steps)
        steps.append(f"s{n} AS MATERIALIZED (SELECT doc_id, CASE WHEN {hit} THEN replace(x, '{a}', ' ') ELSE x END AS x, CASE WHEN {hit} THEN list_append(f, '{b}') ELSE f END AS f FROM s{n - 1})")
    return f"WITH {', '.join(steps)} SELECT doc_id, array_to_string(f, ',') AS terms FROM s{len(steps) - 1} WHERE len(f) > 0"


@book.add(_translated_sql())
def f13_translated(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", L.translated(F.col("text"), P.GLOSSARY).alias("f")).filter(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("terms"))


PAIRS = [(k, s) for k, vs in P.SYNONYMS.items() for s in vs]


def _synonyms(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(PAIRS, "term string, synonym string")


_PAIRS_SQL = "y(term, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"


@book.add(f"""WITH {_PAIRS_SQL}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(coalesce(text_content, '')), '[a-z]+')) AS term FROM rag_chunks), o AS (SELECT * FROM w WHERE term IN ({_list(P.SYNONYMS)})),
    a AS (SELECT id, term, 0 AS h FROM o UNION ALL SELECT o.id, y.synonym, 1 FROM o JOIN y USING (term)) SELECT id, term, CASE WHEN min(h) = 0 THEN 'own' ELSE 'synonym' END AS how FROM a GROUP BY 1, 2""")
def f14_synonyms(t: Tables) -> DataFrame:
    words = t.rag_chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text_content", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    return L.with_synonyms(words.filter(F.col("term").isin(*P.SYNONYMS)), "id", "term", _synonyms(t))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in L.INTENTS) + " ELSE 'search' END"


@book.add(f"SELECT id, {_INTENT} AS intent FROM (SELECT id, lower(coalesce(title, '')) AS x FROM source_items)")
def f15_intents(t: Tables) -> DataFrame:
    return t.source_items.select("id", L.intent(F.col("title")).alias("intent"))


COURT_CODES = [("fxa", "Federal Court of Appeal"), ("bcxc", "Superior Court of British Columbia"), ("onxc", "Superior Court of Ontario")]


@book.add("WITH n(alias, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COURT_CODES) + r"""), k AS (SELECT id, regexp_replace(lower(trim(coalesce(json_extract_string(raw_json, '$.court_code'), ''))), '\s+', ' ', 'g') AS key FROM source_items)
    SELECT k.id, CASE WHEN key = '' THEN '' ELSE coalesce(canonical, 'raw:' || key) END AS court FROM k LEFT JOIN n ON n.alias = k.key""")
def f16_courts(t: Tables) -> DataFrame:
    return L.canonical(t.source_items.select("id", "raw_json"), F.get_json_object("raw_json", "$.court_code"), t.spark.createDataFrame(COURT_CODES, "alias string, canonical string"), "court").select("id", "court")


_GENERIC = sorted(P.GENERIC)
_DOMAIN = sorted({w for ws in P.DOMAINS.values() for w in ws})
_W = P.WEIGHTS


@book.add(f"""WITH {_PAIRS_SQL}, x AS (SELECT id, lower(coalesce(title, '')) AS x FROM source_items), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(x, '[a-z][a-z''-]{{2,}}')) AS term FROM x),
    a AS (SELECT id, term, CASE WHEN term IN ({_list(_GENERIC)}) THEN {_W['generic']} ELSE {_W['typed']} END::DOUBLE AS weight FROM w UNION ALL SELECT w.id, y.synonym, {_W['expanded']} FROM w JOIN y USING (term) WHERE term NOT IN ({_list(_GENERIC)})
    UNION ALL SELECT id, unnest(regexp_extract_all(x, '"([^"]+)"', 1)), {_W['quoted']} FROM x) SELECT id, term, max(weight) AS weight FROM a GROUP BY 1, 2""")
def r40_term_weights(t: Tables) -> DataFrame:
    return L.weighted_terms(t.source_items, "id", "title", _GENERIC, _synonyms(t), _DOMAIN, _W)


#: What is taken as an entity: type, pattern with the name as its group, confidence (fixed values).
FAMILIES = (("citation", r"(?:^|[^A-Za-z0-9])((?:19|20)[0-9]{2} [A-Z]{2,6} [0-9]+)", 0.99), ("statute", r"((?:[A-Z][a-z]+ ){1,5}(?:Act|Regulations|Rules))(?:[^A-Za-z]|$)", 0.96), ("section", r"(?:^|[^A-Za-z])((?:[Ss]ection|s\.) [0-9]+)", 0.94), ("court", r"((?:Supreme|Federal|Superior) Court|Court of Appeal)", 0.98))
CONCEPTS = ("easement", "lease", "mortgage", "landlord", "refund")
CONCEPT_CONFIDENCE = 0.72


def mentions(t: Tables) -> DataFrame:
    """(document, entity, entity_type, name, confidence) of the first chunk of every document; entities are keyed by type and small letters."""
    first = R.first_per_group(t.rag_chunks.select("id", "source_table", "source_id", "chunk_index", "text_content"), ["source_table", "source_id"], ["chunk_index", "id"])
    body = F.coalesce("text_content", F.lit(""))

    def family(kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("name"), F.lit(confidence).alias("confidence")))

    named = [family(*f) for f in FAMILIES]
    ideas = F.filter(F.array(*[F.struct(F.lit("concept").alias("entity_type"), F.lit(x).alias("name"), F.lit(CONCEPT_CONFIDENCE).alias("confidence")) for x in CONCEPTS]), lambda e: F.contains(F.lower(body), e["name"]))
    document = F.concat_ws(":", F.lit("doc"), "source_table", F.col("source_id").cast("string"))
    rows = first.select(document.alias("document"), F.explode(F.concat(*named, ideas)).alias("e")).select("document", "e.*")
    entity = F.concat_ws(":", "entity_type", F.lower("name"))
    return rows.groupBy("document", entity.alias("entity"), "entity_type").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"))


_MENTIONS = "f AS (SELECT 'doc:' || source_table || ':' || source_id AS document, coalesce(text_content, '') AS x FROM rag_chunks QUALIFY row_number() OVER (PARTITION BY source_table, source_id ORDER BY chunk_index, id) = 1), e AS (" + " UNION ALL ".join(f"SELECT document, '{n}' AS entity_type, unnest(regexp_extract_all(x, '{p}', 1)) AS name, {c}::DOUBLE AS confidence FROM f" for n, p, c in FAMILIES) + " UNION ALL " + " UNION ALL ".join(f"SELECT document, 'concept', '{x}', {CONCEPT_CONFIDENCE} FROM f WHERE contains(lower(x), '{x}')" for x in CONCEPTS) + "), m AS (SELECT document, entity_type || ':' || lower(name) AS entity, entity_type, min(name) AS name, max(confidence) AS confidence FROM e GROUP BY 1, 2, 3)"


@book.add(f"WITH {_MENTIONS} SELECT document, entity, entity_type, name, confidence, sha256(document || '|' || entity || '|mentions') AS edge_key FROM m")
def r24_entity_mentions(t: Tables) -> DataFrame:
    """The graph's seed: an edge from each document to each entity and concept of its first chunk."""
    return mentions(t).withColumn("edge_key", G.edge_key(F.col("document"), F.col("entity"), F.lit("mentions")))


@book.add(f"WITH {_MENTIONS} SELECT entity_type, count(DISTINCT entity) AS entities, count(*) AS edges FROM m GROUP BY 1")
def r28_seeded_types(t: Tables) -> DataFrame:
    return mentions(t).groupBy("entity_type").agg(F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("edges"))


@book.add(f"""WITH {_MENTIONS}, u AS (SELECT document AS x, entity AS y, confidence AS c FROM m UNION ALL SELECT entity, document, confidence FROM m), s(node, score) AS (VALUES ('concept:easement', 0.9::DOUBLE), ('concept:refund', 0.7::DOUBLE)),
    l1 AS (SELECT y AS node, max(score * c * 0.92) AS score FROM u JOIN s ON x = node GROUP BY 1), l2 AS (SELECT y AS node, max(score * c * 0.82) AS score FROM u JOIN l1 ON x = node GROUP BY 1), l3 AS (SELECT y AS node, max(score * c * 0.82) AS score FROM u JOIN l2 ON x = node GROUP BY 1),
    p AS (SELECT node, round(max(score), 6) AS path FROM (SELECT * FROM s UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1),
    k AS (SELECT c.id, c.source_table || ':' || c.source_id AS document, round(p.path * m.confidence, 6) AS score FROM rag_chunks c JOIN m ON m.document = 'doc:' || c.source_table || ':' || c.source_id JOIN p ON p.node = m.entity)
    SELECT id, document, score FROM k QUALIFY row_number() OVER (PARTITION BY document ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 30""")
def r27_entity_search(t: Tables) -> DataFrame:
    """From the query's concepts along mentions, three hops, to the chunks of the documents reached."""
    m = mentions(t)
    edges = m.select(F.col("document").alias("source_id"), F.col("entity").alias("target_id"), "confidence")
    start = t.spark.createDataFrame([("concept:easement", 0.9), ("concept:refund", 0.7)], "node string, score double")
    paths = G.best_paths(edges, start, 3)
    chunks = t.rag_chunks.select("id", F.concat_ws(":", "source_table", F.col("source_id").cast("string")).alias("document"))
    # a document's best mention first: it holds for all of its chunks
    best = m.join(paths.select(F.col("node").alias("entity"), F.col("score").alias("path")), "entity").groupBy(F.substring("document", 5, 1 << 20).alias("document")).agg(F.max(F.round(F.col("path") * F.col("confidence"), 6)).alias("score"))
    return chunks.groupBy("document").agg(F.min("id").alias("id")).join(best, "document").orderBy(F.desc("score"), "id").limit(30).select("id", "document", "score")


QUESTION = 'Can a landlord in Ontario end a lease? "notice to quit"'


@book.add("""SELECT * FROM (VALUES ('query', 'place', 'Ontario', 1.0::DOUBLE), ('query', 'domain', 'tenancy', 0.65), ('query', 'quoted', 'notice to quit', 1.35), ('query', 'typed', 'landlord', 1.0), ('query', 'typed', 'lease', 1.0), ('query', 'typed', 'end', 1.0), ('query', 'typed', 'ontario', 1.0), ('query', 'typed', 'can', 1.0), ('query', 'typed', 'notice', 1.0), ('query', 'typed', 'quit', 1.0),
    ('query', 'expanded', 'lessor', 0.85), ('query', 'domain term', 'tenant', 0.65)) v(source, relation, target, weight)""")
def r29_query_graph(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(P.query_edges(QUESTION), "source string, relation string, target string, weight double")


_CITE = r"(.{0,60}?)([0-9]{4} [A-Z]{2,6} [0-9]+|S\.[A-Z]\. [0-9]{4}, c\. [0-9]+)"


@book.add(f"""WITH c AS (SELECT id, case_item_id, evidence_excerpt AS x FROM canada_case_law_links WHERE evidence_excerpt IS NOT NULL), m AS (SELECT id, case_item_id, lower(regexp_extract(x, '{_CITE}', 1)) AS before, regexp_extract(x, '{_CITE}', 2) AS ref FROM c WHERE regexp_matches(x, '{_CITE}')),
    k AS (SELECT *, CASE WHEN contains(before, 'appl') THEN 'applied' WHEN contains(before, 'expla') THEN 'explained' WHEN contains(before, 'disting') THEN 'distinguished' WHEN regexp_matches(before, 'cit|turned|relying|pursuant') THEN 'cited' ELSE 'related' END AS relation FROM m)
    SELECT id, case_item_id, ref, relation, round(least(1.0, CASE relation WHEN 'cited' THEN 1.0 WHEN 'applied' THEN 0.9 WHEN 'explained' THEN 0.8 WHEN 'distinguished' THEN 0.7 ELSE 0.6 END + CASE WHEN length(before) > 20 THEN 0.05 ELSE 0 END + CASE WHEN length(before) > 40 THEN 0.05 ELSE 0 END)::DOUBLE, 4) AS score FROM k""")
def r35_citations_in_text(t: Tables) -> DataFrame:
    """The citation of each excerpt, its relation by the words before it, and a score by relation and length of those words."""
    rows = t.canada_case_law_links.filter(F.col("evidence_excerpt").rlike(_CITE)).select("id", "case_item_id", F.lower(F.regexp_extract("evidence_excerpt", _CITE, 1)).alias("b"), F.regexp_extract("evidence_excerpt", _CITE, 2).alias("ref"))
    b = F.col("b")
    told = F.when(b.contains("appl"), "applied").when(b.contains("expla"), "explained").when(b.contains("disting"), "distinguished").when(b.rlike("cit|turned|relying|pursuant"), "cited").otherwise("related")
    rows = rows.withColumn("relation", told)
    worth = F.when(F.col("relation") == "cited", 1.0).when(F.col("relation") == "applied", 0.9).when(F.col("relation") == "explained", 0.8).when(F.col("relation") == "distinguished", 0.7).otherwise(0.6)
    more = F.when(F.length("b") > 20, 0.05).otherwise(0.0) + F.when(F.length("b") > 40, 0.05).otherwise(0.0)
    return rows.select("id", "case_item_id", "ref", "relation", F.round(F.least(F.lit(1.0), worth + more), 4).alias("score"))


GROUPS = [("tenancy", "lease"), ("tenancy", "tenan"), ("tenancy", "landlord"), ("goods", "sale"), ("goods", "warrant"), ("water", "wharf"), ("water", "harbour"), ("water", "ferry")]
ALIAS_OF = [("tenancy", "residential tenancy"), ("tenancy", "rental"), ("goods", "sale of goods"), ("water", "navigation"), ("water", "port")]


@book.add("WITH g(grp, marker) AS (VALUES " + ", ".join(map(str, GROUPS)) + "), a(grp, alias) AS (VALUES " + ", ".join(map(str, ALIAS_OF)) + """), k AS (SELECT id, lower(title) AS keyword FROM canada_laws WHERE title IS NOT NULL),
    x AS (SELECT DISTINCT k.id, g.grp FROM k JOIN g ON contains(k.keyword, g.marker)) SELECT id, keyword FROM k UNION SELECT x.id, a.alias FROM x JOIN a USING (grp)""")
def k02_alias_groups(t: Tables) -> DataFrame:
    """Keywords with all aliases of every group of which they contain a marker; markers are a constant, aliases a small table."""
    k = t.canada_laws.filter("title is not null").select("id", F.lower("title").alias("keyword"))
    markers = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(m).alias("m")) for g, m in GROUPS])
    hit = k.select("id", F.explode(F.array_distinct(F.transform(F.filter(markers, lambda x: F.contains(F.col("keyword"), x["m"])), lambda x: x["grp"]))).alias("grp"))
    more = hit.join(t.spark.createDataFrame(ALIAS_OF, "grp string, alias string"), "grp").select("id", F.col("alias").alias("keyword"))
    return k.unionByName(more).distinct()


_TITLE = "lower(trim(coalesce({}, '')))"


@book.add(f"""WITH have AS (SELECT DISTINCT law_id, case_item_id FROM canada_case_law_links WHERE law_id IS NOT NULL), r AS (SELECT l.id AS law_id, k.case_item_id, max(coalesce(k.match_score, 0)) AS score FROM canada_case_law_links k JOIN canada_laws l ON {_TITLE.format('k.matched_alias')} = {_TITLE.format('l.title')} WHERE k.law_id IS NULL AND l.origin = 'official' GROUP BY 1, 2),
    n AS (SELECT r.* FROM r ANTI JOIN have USING (law_id, case_item_id) QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY score DESC, case_item_id) <= 12)
    SELECT law_id, case_item_id, 'present' AS status FROM have UNION ALL SELECT law_id, case_item_id, 'pending' FROM n""")
def k07_retrieved_cases(t: Tables) -> DataFrame:
    """The cases of each law, and up to 12 retrieved ones that it does not have yet, pending."""
    title = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    have = t.canada_case_law_links.filter("law_id is not null").select("law_id", "case_item_id").distinct()
    laws = t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("law_id"), title("title").alias("name"))
    r = t.canada_case_law_links.filter("law_id is null").select("case_item_id", "match_score", title("matched_alias").alias("name")).join(laws, "name").groupBy("law_id", "case_item_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("score"))
    new = R.first_per_group(r.join(have, ["law_id", "case_item_id"], "left_anti"), ["law_id"], [F.desc("score"), "case_item_id"], 12)
    return have.withColumn("status", F.lit("present")).unionByName(new.select("law_id", "case_item_id", F.lit("pending").alias("status")))


@book.add("""WITH l AS (SELECT 'law' AS module, coalesce(law_kind, '') AS grp, id, title, row_number() OVER (PARTITION BY coalesce(law_kind, '') ORDER BY (origin = 'official') DESC, title, id) AS place FROM canada_laws),
    c AS (SELECT 'case' AS module, coalesce(json_extract_string(raw_json, '$.court_code'), '') AS grp, id, title, row_number() OVER (PARTITION BY coalesce(json_extract_string(raw_json, '$.court_code'), '') ORDER BY published_at DESC NULLS LAST, id) AS place FROM source_items WHERE json_extract_string(raw_json, '$.kind') = 'case')
    SELECT 'all' AS asked, module, grp, id, title, CAST(place AS INT) AS place FROM (SELECT * FROM l UNION ALL SELECT * FROM c) WHERE place <= 4 UNION ALL SELECT 'law', module, grp, id, title, CAST(place AS INT) FROM l WHERE place <= 4""")
def k10_module_packets(t: Tables) -> DataFrame:
    """The packet of a module: its authority groups, four entries each; 'all' has every module's."""

    def laws() -> DataFrame:
        rows = t.canada_laws.select(F.lit("law").alias("module"), F.coalesce("law_kind", F.lit("")).alias("grp"), "id", "title", (F.col("origin") == "official").alias("o"))
        w = Window.partitionBy("grp").orderBy(F.desc("o"), "title", "id")
        return rows.withColumn("place", F.row_number().over(w)).filter("place <= 4").drop("o")

    def cases() -> DataFrame:
        rows = t.source_items.filter(F.get_json_object("raw_json", "$.kind") == "case").select(F.lit("case").alias("module"), F.coalesce(F.get_json_object("raw_json", "$.court_code"), F.lit("")).alias("grp"), "id", "title", "published_at")
        w = Window.partitionBy("grp").orderBy(F.desc_nulls_last("published_at"), "id")
        return rows.withColumn("place", F.row_number().over(w)).filter("place <= 4").drop("published_at")

    modules = {"law": laws, "case": cases}

    def packet(asked: str) -> DataFrame:
        parts = [make() for name, make in modules.items() if asked in ("all", name)]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.select(F.lit(asked).alias("asked"), "module", "grp", "id", "title", "place")

    return packet("all").unionByName(packet("law"))


@book.add("""WITH k AS (SELECT law_id, case_item_id, max(coalesce(match_score, 0)) AS s, count(*) AS n FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1, 2), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY s DESC, n DESC, case_item_id) <= 5)
    SELECT c.law_id, l.title AS law, c.case_item_id, i.title AS case_title, round(c.s, 4) AS score, 'cites ' || coalesce(l.citation, l.title) || ' ' || c.n || 'x' AS reason FROM c JOIN canada_laws l ON l.id = c.law_id JOIN source_items i ON i.id = c.case_item_id""")
def k13_prediction_evidence(t: Tables) -> DataFrame:
    """The five surest cases of each law with the reason they are shown."""
    k = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id", "case_item_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"))
    c = R.first_per_group(k, ["law_id"], [F.desc("s"), F.desc("n"), "case_item_id"], 5)
    laws = t.canada_laws.select(F.col("id").alias("law_id"), F.col("title").alias("law"), F.coalesce("citation", "title").alias("cited"))
    rows = c.join(laws, "law_id").join(t.source_items.select(F.col("id").alias("case_item_id"), F.col("title").alias("case_title")), "case_item_id")
    return rows.select("law_id", "law", "case_item_id", "case_title", F.round("s", 4).alias("score"), F.concat(F.lit("cites "), "cited", F.lit(" "), F.col("n").cast("string"), F.lit("x")).alias("reason"))


ISSUES = [("tenancy", "residential leases tenants"), ("quota", "kiln quotas levies"), ("water", "wharves harbours lighting"), ("insolvency", "bankrupt estates")]


def _stems(words: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({words}), '[a-z]+'), lambda x: length(x) >= 4), lambda x: regexp_replace(x, '(ies|es|s)$', '')))"


def _stemmed(words: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower(words), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4), lambda x: F.regexp_replace(x, "(ies|es|s)$", "")))


@book.add("WITH i(issue, words) AS (VALUES " + ", ".join(map(str, ISSUES)) + f"), s AS (SELECT issue, unnest({_stems('words')}) AS w FROM i), l AS (SELECT id, title, unnest({_stems('title')}) AS w FROM canada_laws WHERE origin = 'official')," + """
    o AS (SELECT issue, l.id AS law_id, any_value(title) AS title, count(*) AS overlap FROM s JOIN l USING (w) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY overlap DESC, title, law_id) AS place FROM o),
    k AS (SELECT law_id, count(DISTINCT case_item_id) AS cases FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1), x AS (SELECT t.*, coalesce(k.cases, 0) AS cases FROM t LEFT JOIN k USING (law_id) WHERE place <= 4)
    SELECT issue, law_id, title, CAST(place AS INT) AS place, overlap, cases, round((0.4 * least(overlap / 3.0, 1) + 0.35 + 0.25 * (cases > 0)::INT)::DOUBLE, 4) AS strength FROM x""")
def k14_issue_authorities(t: Tables) -> DataFrame:
    """The four laws that match each issue best by words without their plural, with the strength of the issue under each."""
    issues = t.spark.createDataFrame(ISSUES, "issue string, words string").select("issue", F.explode(_stemmed(F.col("words"))).alias("w"))
    laws = t.canada_laws.filter("origin = 'official'").select(F.col("id").alias("law_id"), "title", F.explode(_stemmed(F.col("title"))).alias("w"))
    o = issues.join(laws, "w").groupBy("issue", "law_id", "title").agg(F.count(F.lit(1)).alias("overlap"))
    top = o.withColumn("place", F.row_number().over(Window.partitionBy("issue").orderBy(F.desc("overlap"), "title", "law_id"))).filter("place <= 4")
    k = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id").agg(F.count_distinct("case_item_id").alias("c"))
    rows = top.join(k, "law_id", "left").withColumn("cases", F.coalesce("c", F.lit(0)))
    return rows.select("issue", "law_id", "title", "place", "overlap", "cases", F.round(0.4 * F.least(F.col("overlap") / 3.0, F.lit(1.0)) + 0.35 + 0.25 * (F.col("cases") > 0).cast("int"), 4).alias("strength"))


@book.add(f"""WITH q AS (SELECT DISTINCT {_TITLE.format('title')} AS question FROM canada_laws), a AS (SELECT {_TITLE.format('matched_alias')} AS question, id, law_id, updated_at FROM canada_case_law_links WHERE law_id IS NOT NULL)
    SELECT question, a.id AS answer_id, law_id FROM q JOIN a USING (question) WHERE question <> '' QUALIFY row_number() OVER (PARTITION BY question ORDER BY updated_at DESC NULLS LAST, a.id DESC) = 1""")
def k28_past_answers(t: Tables) -> DataFrame:
    """The newest answer to exactly the same question."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    asked = t.canada_laws.select(text("title").alias("question")).filter("question <> ''").distinct()
    past = t.canada_case_law_links.filter("law_id is not null").select(text("matched_alias").alias("question"), F.col("id").alias("answer_id"), "law_id", "updated_at")
    return R.first_per_group(past.join(asked, "question", "left_semi"), ["question"], [F.desc_nulls_last("updated_at"), F.desc("answer_id")]).select("question", "answer_id", "law_id")
