"""Full-text search with phrases, exclusions, alternatives and a fallback; each query with SQL over the texts themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.planner import GENERIC
from docketry.operators import fulltext as T
from docketry.operators import relational as R
from docketry.plans.book import Book, Tables

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

ASKED = ("easement lease", '"costs fixed" notice', "landlord -tenant", '"the easement" or mortgage costs', "lease zzzz easement costs", '-"with costs"')
#: No text has all of these, so that the fallback answers.
RARE = "the easement zzzz landlord costs"
WORDS = r"regexp_extract_all(lower(coalesce(text_content, '')), '[\p{L}\p{N}]+')"
TEXTS = f"w AS (SELECT id, source_table, jurisdiction, published_at, {WORDS} AS w FROM rag_chunks), t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s FROM w)"


def _worth(terms: list[str]) -> str:
    n = lambda x: f"len(list_filter(w, lambda x: x = '{x}'))"
    return "round(" + " + ".join(f"CASE WHEN {n(x)} > 0 THEN 1 + ln({n(x)}) ELSE 0 END" for x in terms) + ", 6)::DOUBLE"


def _matched(query: str) -> tuple[str, str]:
    """The condition and the score of a query in SQL over padded texts."""
    has = lambda p: f"contains(s, ' {' '.join(p)} ')"
    groups = T.parse(query)
    cond = " OR ".join("(" + " AND ".join([has(p) for p in g.wanted] + [f"NOT {has(p)}" for p in g.barred]) + ")" for g in groups) or "false"
    terms = sorted({x for g in groups for p in g.wanted for x in p})
    return cond, _worth(terms) if terms else "0.0::DOUBLE"


def _any(query: str) -> tuple[str, str]:
    first, *rest = T.fallback_terms(query, GENERIC | {"the"})
    has = lambda x: f"contains(s, ' {x} ')"
    return f"{has(first)} AND ({' OR '.join(map(has, rest))})", _worth([first, *rest])


@book.add(f"WITH w AS (SELECT id, {WORDS} AS w FROM rag_chunks), u AS (SELECT id, unnest(w) AS term FROM w) SELECT term, id, count(*) AS tf FROM u GROUP BY 1, 2")
def r01_index_terms(t: Tables) -> DataFrame:
    return T.index(t.rag_chunks, "id", "text_content").select("term", "id", "tf")


@book.add(f"WITH {TEXTS} " + " UNION ALL ".join(f"SELECT {i} AS q, id, {_matched(q)[1]} AS score FROM t WHERE {_matched(q)[0]}" for i, q in enumerate(ASKED)))
def r02_websearch(t: Tables) -> DataFrame:
    kept = T.keep(T.index(t.rag_chunks, "id", "text_content"))
    return reduce(DataFrame.unionByName, [T.match(kept, "id", q).select(F.lit(i).alias("q"), "id", "score") for i, q in enumerate(ASKED)])


@book.add(f"WITH {TEXTS} SELECT id, {_any(RARE)[1]} AS score FROM t WHERE {_any(RARE)[0]}")
def r03_fallback_search(t: Tables) -> DataFrame:
    return T.match_any(T.index(t.rag_chunks, "id", "text_content"), "id", T.fallback_terms(RARE, GENERIC | {"the"}))


_SCOPE = "source_table = 'source_items' AND jurisdiction IN ('Ontario', 'Canada')"


@book.add(f"""WITH {TEXTS}, e AS (SELECT 0 AS q, id, {_matched(ASKED[0])[1]} AS score, published_at FROM t WHERE ({_matched(ASKED[0])[0]}) AND {_SCOPE}),
    f AS (SELECT 1 AS q, id, {_any(RARE)[1]} AS score, published_at FROM t WHERE {_any(RARE)[0]} AND {_SCOPE})
    SELECT q, id, score FROM (SELECT * FROM e UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, published_at DESC NULLS LAST, id) <= 30""")
def r04_fulltext_search(t: Tables) -> DataFrame:
    kept = T.keep(T.index(t.rag_chunks, "id", "text_content"))
    found = [T.search(kept, t.rag_chunks, "id", q, F.expr(_SCOPE), 30, GENERIC | {"the"}).withColumn("q", F.lit(i)) for i, q in enumerate((ASKED[0], RARE))]
    return reduce(DataFrame.unionByName, found).select("q", "id", "score")


_POINTS = " + ".join(f"(CASE WHEN contains(lower(coalesce(title, '')), '{x}') THEN 5 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), '{x}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(raw_text, '')), '{x}') THEN 1 ELSE 0 END) * {w}" for x, w in (("easement", 1.0), ("landlord", 0.85), ("costs", 0.35)))
_LEVEL = "CASE WHEN court IN ('scc', 'uksc') THEN 5 WHEN ends_with(court, 'ca') THEN 4 WHEN court LIKE '%sc' OR court LIKE '%kb' THEN 3 WHEN ends_with(court, 'pc') THEN 2 WHEN court <> '' THEN 1 ELSE 0 END"


@book.add(f"""WITH s AS (SELECT id, lower(trim(coalesce(source_code, ''))) AS code, published_at, lower(coalesce(json_extract_string(raw_json, '$.court_code'), '')) AS court, round(({_POINTS}) / (3 * 13.0), 4)::DOUBLE AS score FROM source_items),
    h AS (SELECT *, {_LEVEL} AS level FROM s WHERE score > 0), c AS (SELECT code, count(*) AS n FROM h GROUP BY 1)
    SELECT h.id, h.score, CAST(h.level AS INT) AS court_level, c.n AS in_source, (SELECT count(*) FROM h) AS total FROM h JOIN c USING (code) ORDER BY h.score DESC, level DESC, published_at DESC NULLS LAST, h.id LIMIT 20 OFFSET 20""")
def r06_weighted_facets(t: Tables) -> DataFrame:
    """Points of the keywords, the court's level, the hits of the source and of all, and the second page."""
    s = t.source_items.select("id", F.lower(F.trim(F.coalesce("source_code", F.lit("")))).alias("code"), "published_at", F.lower(F.coalesce(F.get_json_object("raw_json", "$.court_code"), F.lit(""))).alias("court"), F.expr(f"round(cast(({_POINTS}) as double) / 39.0, 4)").alias("score"))
    hits = s.filter("score > 0").withColumn("level", F.expr(_LEVEL.replace("ends_with", "endswith")).cast("int"))
    counts = hits.groupBy("code").agg(F.count(F.lit(1)).alias("in_source"))
    # a row per source: its size is that of a code list
    page = hits.orderBy(F.desc("score"), F.desc("level"), F.desc_nulls_last("published_at"), "id").offset(20).limit(20)
    return page.join(counts, "code").join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))), F.lit(True)).select("id", "score", F.col("level").alias("court_level"), "in_source", "total")


@book.add(f"""WITH {TEXTS}, m AS (SELECT t.id, t.source_table, c.source_id, {_matched(ASKED[0])[1]} AS score FROM t JOIN rag_chunks c ON c.id = t.id WHERE {_matched(ASKED[0])[0]}),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_table, source_id ORDER BY score DESC, id) = 1), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_table ORDER BY score DESC, id) <= 12),
    n AS (SELECT *, round(score / greatest(1.0, max(score) OVER (PARTITION BY source_table)), 6) AS similarity FROM k)
    SELECT id, source_table, similarity, row_number() OVER (ORDER BY similarity DESC, source_table = 'canada_laws' DESC, id)::INT AS place FROM n""")
def r07_fast_path(t: Tables) -> DataFrame:
    """The best 12 documents of each kind, made comparable by their kind's best, in one list."""
    found = T.match(T.index(t.rag_chunks, "id", "text_content"), "id", ASKED[0]).join(t.rag_chunks.select("id", "source_table", "source_id"), "id")
    best = R.first_per_group(R.first_per_group(found, ["source_table", "source_id"], [F.desc("score"), "id"]), ["source_table"], [F.desc("score"), "id"], 12)
    return R.placed(best.select("id", "source_table", F.round(F.col("score") / F.greatest(F.lit(1.0), F.max("score").over(R.Window.partitionBy("source_table"))), 6).alias("similarity")), [F.desc("similarity"), F.desc(F.col("source_table") == "canada_laws"), "id"], "place")
