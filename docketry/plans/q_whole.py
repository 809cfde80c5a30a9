"""Operators on all their inputs: assembly, queues, measures, evidence and packets; beside the reduced forms of other modules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators import assembly as A
from docketry.operators import dictionary as D
from docketry.operators import relational as R
from docketry.operators import relevance as S
from docketry.plans.book import Book, Tables
from docketry.runtime import checkpoint_dir
from docketry.sources import files

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

#: A literal sanctions list in the four files' form.
ENTITIES = [(36, "AEROCARIBBEAN AIRLINES", "-0-", "CUBA", "-0- "), (173, "ANGLO LINES", "vessel", "CUBA] [SDGT", "Linked to 36."), (306, " BANK OF QUAYS ", "individual", "SDGT; IRAN", "-0-"), (400, "-0-", "individual", "-0-", None)]
ADDRESSES = [(36, 2, "-0-", "Havana", "Cuba"), (36, 1, "12 Pier Road", "-0-", "Cuba"), (173, 5, "-0-", "-0-", "-0-"), (306, 7, "9 Dock St", "London", "England"), (999, 1, "x", "y", "z")]
ALIASES = [(36, 12, "AERO-CARIBBEAN"), (306, 3, "BOQ"), (306, 1, "QUAY BANK"), (306, 2, "-0-")]
COMMENTS = [(36, "Second note."), (36, "First note."), (173, "-0-"), (306, "Alt. office closed")]


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_CLEAN = "CASE WHEN trim(coalesce({0}, '')) = '-0-' THEN '' ELSE trim(coalesce({0}, '')) END"
SANCTIONS_SQL = f"""WITH ent(ent_num, name, kind, program, remarks) AS ({_values(ENTITIES)}), addr(ent_num, add_num, address, city, country) AS ({_values(ADDRESSES)}),
    alt(ent_num, alt_num, name) AS ({_values(ALIASES)}), com(ent_num, remarks) AS ({_values(COMMENTS)}),
    a AS (SELECT ent_num, string_agg(p, '; ' ORDER BY add_num) AS addresses, count(*)::INT AS n_addresses FROM (SELECT ent_num, add_num, array_to_string(list_filter([{_CLEAN.format('address')}, {_CLEAN.format('city')}, {_CLEAN.format('country')}], lambda x: x <> ''), ', ') AS p FROM addr) WHERE p <> '' GROUP BY 1),
    l AS (SELECT ent_num, string_agg(p, '; ' ORDER BY alt_num) AS aliases, count(*)::INT AS n_aliases FROM (SELECT ent_num, alt_num, {_CLEAN.format('name')} AS p FROM alt) WHERE p <> '' GROUP BY 1),
    c AS (SELECT ent_num, string_agg(p, ' ' ORDER BY p) AS comment FROM (SELECT ent_num, {_CLEAN.format('remarks')} AS p FROM com) WHERE p <> '' GROUP BY 1),
    r AS (SELECT ent.ent_num, {_CLEAN.format('ent.name')} AS name, {_CLEAN.format('kind')} AS kind, {_CLEAN.format('program')} AS program, trim({_CLEAN.format('ent.remarks')} || ' ' || coalesce(comment, '')) AS remarks, coalesce(addresses, '') AS addresses, coalesce(n_addresses, 0) AS n_addresses,
        coalesce(aliases, '') AS aliases, coalesce(n_aliases, 0) AS n_aliases FROM ent LEFT JOIN a USING (ent_num) LEFT JOIN l USING (ent_num) LEFT JOIN c USING (ent_num))"""


def _sanctions(t: Tables) -> DataFrame:
    """The four files written as CSV with headers, and read back."""
    folder = f"{checkpoint_dir(t.spark)}/sanctions-{uuid.uuid4().hex}"
    frames = []
    for name, rows, schema in (("ent", ENTITIES, "ent_num int, name string, kind string, program string, remarks string"), ("add", ADDRESSES, "ent_num int, add_num int, address string, city string, country string"), ("alt", ALIASES, "ent_num int, alt_num int, name string"), ("com", COMMENTS, "ent_num int, remarks string")):
        df = t.spark.createDataFrame(rows, schema)
        df.coalesce(1).write.option("header", True).option("nullValue", "").csv(f"{folder}/{name}")
        frames.append(files.read_csv(t.spark, f"{folder}/{name}", schema))
    return A.sanctions(*frames)


@book.add(SANCTIONS_SQL + " SELECT * FROM r")
def s04_sanctions_records(t: Tables) -> DataFrame:
    return _sanctions(t)


@book.add(SANCTIONS_SQL + r", p AS (SELECT ent_num, n_aliases, n_addresses, unnest(list_distinct(list_filter(list_transform(string_split_regex(program, '[;\]]'), lambda x: trim(regexp_replace(x, '[\[\]]', '', 'g'))), lambda x: x <> ''))) AS program FROM r) SELECT program, count(DISTINCT ent_num) AS entities, sum(n_aliases)::BIGINT AS aliases, sum(n_addresses)::BIGINT AS addresses FROM p GROUP BY 1")
def k09_programs(t: Tables) -> DataFrame:
    return A.by_program(_sanctions(t))


@book.add("SELECT 'missing' AS side, id FROM source_items WHERE raw_text IS NOT NULL AND published_at IS NULL UNION ALL SELECT 'unexpected', id FROM source_items WHERE raw_text IS NULL AND published_at IS NOT NULL")
def s13_archive_integrity(t: Tables) -> DataFrame:
    """Items with a text are expected in an archive; it was written of the items with a date, and is read back."""
    folder = f"{checkpoint_dir(t.spark)}/archive-{uuid.uuid4().hex}"
    files.write_archive(t.source_items.filter("published_at is not null").select("id", "source_code", "title"), "id", folder)
    there = files.read_archive(t.spark, folder, "id bigint, source_code string, title string")
    expected = t.source_items.filter("raw_text is not null")
    return R.set_difference(expected, there, ["id"]).withColumn("side", F.lit("missing")).unionByName(R.set_difference(there, expected, ["id"]).withColumn("side", F.lit("unexpected")))


@book.add("SELECT count(*) AS n, true AS in_order FROM source_items")
def s12_ordered_export(t: Tables) -> DataFrame:
    """An export in order of ids, read back: every file's ids are beyond those of the file before."""
    folder = f"{checkpoint_dir(t.spark)}/export-{uuid.uuid4().hex}"
    files.write_ordered(t.source_items.select("id", "source_code", "title"), "id", folder)
    back = t.spark.read.schema("id bigint").json(folder).select("id", F.col("_metadata.file_name").alias("f"))
    ranges = back.groupBy("f").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    # a row per file
    placed = ranges.withColumn("before", F.lag("hi").over(Window.orderBy("f")))
    return placed.agg(F.sum("n").cast("bigint").alias("n"), F.every(F.coalesce(F.col("before") < F.col("lo"), F.lit(True))).alias("in_order"))


@book.add("SELECT page, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS page FROM rag_chunks) GROUP BY 1")
def s15_all_pages(t: Tables) -> DataFrame:
    """All pages of a keyset scan at once: where each begins and ends."""
    pages = A.numbered(t.rag_chunks.select("id"), "id").withColumn("page", F.expr("number div 500"))
    return pages.groupBy("page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@book.add("SELECT id, source_table FROM rag_chunks WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR) || 'trial'), 1, 8) AS BIGINT) < CAST(0.1 * 4294967296 AS BIGINT)")
def s22_sample(t: Tables) -> DataFrame:
    return A.sampled(t.rag_chunks, "id", 0.1, "trial").select("id", "source_table")


@book.add("""WITH c AS (SELECT coalesce(nullif(lower(trim(source_code)), ''), 'unknown') AS code, id, created_at, updated_at FROM source_items), b AS (SELECT max(id) AS top FROM source_items),
    n AS (SELECT code, count(*) AS n, max(id) AS i, max(updated_at) AS u FROM c GROUP BY 1), o AS (SELECT code, count(*) AS n, max(id) AS i, max(updated_at) AS u FROM c, b WHERE id <= top * 0.9 GROUP BY 1)
    SELECT code, CASE WHEN o.n IS NULL THEN 'new' WHEN n.n = o.n AND n.i = o.i AND n.u IS NOT DISTINCT FROM o.u THEN 'unchanged' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (code)""")
def s23_changed_sources(t: Tables) -> DataFrame:
    """The signature of each source against one saved before the last tenth of ids came."""
    rows = t.source_items.select(F.coalesce(F.expr("nullif(lower(trim(source_code)), '')"), F.lit("unknown")).alias("code"), "id", "updated_at")
    folder = f"{checkpoint_dir(t.spark)}/signature-{uuid.uuid4().hex}"
    top = rows.agg(F.max("id").alias("top"))
    A.signature(rows.join(F.broadcast(top), F.col("id") <= F.col("top") * 0.9), ["code"]).write.parquet(folder)
    return A.changed_since(A.signature(rows, ["code"]), t.spark.read.parquet(folder), ["code"])


@book.add("""WITH m AS (SELECT max(ts) AS now FROM events), x AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'done' END AS state, value AS priority, ts AS leased_at FROM events),
    r AS (SELECT id, CASE WHEN state = 'running' AND epoch_us(now) - epoch_us(leased_at) > 600000000 THEN 'pending' ELSE state END AS state, state AS was, priority, leased_at, now FROM x, m),
    k AS (SELECT id, row_number() OVER (ORDER BY priority DESC NULLS LAST, id) AS n FROM r WHERE state = 'pending')
    SELECT r.id, CASE WHEN k.n <= 25 THEN 'running' ELSE r.state END AS state, CASE WHEN k.n <= 25 THEN 'me' WHEN r.state <> 'pending' THEN 'other' END AS owner, CASE WHEN k.n <= 25 THEN now WHEN r.state <> 'pending' THEN leased_at END AS leased_at FROM r LEFT JOIN k ON k.id = r.id""")
def x05_leased_claim(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts")).first()[0]
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    tasks = t.events.select(F.col("event_id").alias("id"), state.alias("state"), F.col("value").alias("priority"), F.lit("other").alias("owner"), F.col("ts").alias("leased_at"))
    return A.requeue_and_claim(tasks, F.expr(f"timestamp_ntz'{now}'"), 600, 25, "me")


_ALIAS = "lower(trim(matched_alias))"


@book.add(f"""WITH a AS (SELECT DISTINCT {_ALIAS} AS alias FROM canada_case_law_links WHERE length({_ALIAS}) >= 6), e AS (SELECT a.alias, min(l.id) AS law_id FROM a JOIN canada_laws l ON lower(l.title) = a.alias GROUP BY 1),
    f AS (SELECT a.alias, min(l.id) AS law_id FROM a JOIN canada_laws l ON contains(lower(l.title), a.alias) GROUP BY 1)
    SELECT alias, coalesce(e.law_id, f.law_id) AS law_id, CASE WHEN e.law_id IS NOT NULL THEN 'exact' ELSE 'contained' END AS how FROM f LEFT JOIN e USING (alias)""")
def j13_exact_then_contained(t: Tables) -> DataFrame:
    """Each alias by its equal title, else by the first title that contains it; candidates share the alias's first 6 letters at some place."""
    alias = F.lower(F.trim("matched_alias"))
    asked = t.canada_case_law_links.select(alias.alias("alias")).filter(F.length("alias") >= 6).distinct().withColumn("six", F.substring("alias", 1, 6))
    titles = t.canada_laws.select(F.col("id").alias("law_id"), F.lower("title").alias("title")).filter(F.length("title") >= 6)
    places = titles.select("law_id", "title", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("title") - 5), lambda i: F.substring(F.col("title"), i, F.lit(6))))).alias("six"))
    hits = asked.join(places, "six").filter(F.contains("title", "alias"))
    same = F.col("title") == F.col("alias")
    found = hits.groupBy("alias").agg(F.min(F.when(same, F.col("law_id"))).alias("e"), F.min("law_id").alias("f"))
    return found.select("alias", F.coalesce("e", "f").alias("law_id"), F.when(F.col("e").isNotNull(), "exact").otherwise("contained").alias("how"))


@book.add("""WITH k AS (SELECT law_id, max(coalesce(match_score, 0)) AS score, count(DISTINCT case_item_id) AS cases FROM canada_case_law_links WHERE law_id IS NOT NULL AND case_item_id IN (SELECT id FROM source_items WHERE lower(trim(source_code)) = 'canlii') GROUP BY 1)
    SELECT k.law_id, l.title, round(k.score, 4) AS score, k.cases FROM k JOIN canada_laws l ON l.id = k.law_id ORDER BY k.score DESC, k.cases DESC, k.law_id LIMIT 48""")
def j18_laws_of_a_case_set(t: Tables) -> DataFrame:
    chosen = t.source_items.filter("lower(trim(source_code)) = 'canlii'").select(F.col("id").alias("case_item_id"))
    k = t.canada_case_law_links.filter("law_id is not null").join(chosen, "case_item_id", "left_semi").groupBy("law_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("s"), F.count_distinct("case_item_id").alias("cases"))
    top = k.orderBy(F.desc("s"), F.desc("cases"), "law_id").limit(48)
    return t.canada_laws.select(F.col("id").alias("law_id"), "title").join(F.broadcast(top), "law_id").select("law_id", "title", F.round("s", 4).alias("score"), "cases")


_QUALITY = "0.24 * least(cases / 4.0, 1) + 0.18 * least(laws / 3.0, 1) + 0.16 * summ + 0.12 * url + 0.14 * rules + 0.08 * least(high / 2.0, 1) + 0.08 * clean - 0.18 * untitled - 0.12 * uncited"


@book.add(f"""WITH g AS (SELECT coalesce(json_extract_string(s.raw_json, '$.jurisdiction'), '') AS place, count(DISTINCT s.id) AS cases, count(DISTINCT k.law_id) AS laws, avg((coalesce(trim(s.summary), '') <> '')::INT) AS summ, avg((coalesce(trim(s.item_url), '') <> '')::INT) AS url, avg((k.law_id IS NOT NULL)::INT) AS rules,
    count(*) FILTER (WHERE k.match_score >= 0.9) AS high, avg((strpos(coalesce(s.title, ''), 'Ã') = 0)::INT) AS clean, avg((coalesce(trim(s.title), '') = '')::INT) AS untitled, avg((coalesce(trim(k.matched_alias), '') = '')::INT) AS uncited FROM canada_case_law_links k JOIN source_items s ON s.id = k.case_item_id GROUP BY 1),
    q AS (SELECT *, round(({_QUALITY})::DOUBLE, 4) AS quality FROM g)
    SELECT place, cases, laws, quality, CASE WHEN quality >= 0.72 AND cases >= 2 AND laws >= 1 THEN 'strong' WHEN quality >= 0.45 THEN 'moderate' WHEN cases > 0 THEN 'thin' ELSE 'insufficient' END AS status,
        CASE WHEN quality >= 0.72 AND cases >= 2 AND laws >= 1 THEN 0.84 WHEN quality >= 0.45 THEN 0.68 WHEN cases > 0 THEN 0.45 ELSE 0.25 END::DOUBLE AS confidence FROM q""")
def a23_whole_evidence_quality(t: Tables) -> DataFrame:
    """All eight weighted ratios, both penalties and the ladder, for the cases of each place."""
    filled = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    s = t.source_items.select(F.col("id").alias("case_item_id"), F.coalesce(F.get_json_object("raw_json", "$.jurisdiction"), F.lit("")).alias("place"), filled("summary").alias("a"), filled("item_url").alias("b"), (~F.contains(F.coalesce("title", F.lit("")), F.lit("Ã"))).cast("int").alias("c"), (1 - filled("title")).alias("d"))
    k = t.canada_case_law_links.select("case_item_id", "law_id", "match_score", (1 - filled("matched_alias")).alias("e")).join(s, "case_item_id")
    g = k.groupBy("place").agg(F.count_distinct("case_item_id").alias("cases"), F.count_distinct("law_id").alias("laws"), F.avg("a").alias("summ"), F.avg("b").alias("url"), F.avg(F.col("law_id").isNotNull().cast("int")).alias("rules"), F.count_if(F.col("match_score") >= 0.9).alias("high"), F.avg("c").alias("clean"), F.avg("d").alias("untitled"), F.avg("e").alias("uncited"))
    q = g.withColumn("quality", F.expr(f"round(cast({_QUALITY} as double), 4)"))
    strong, fair = F.expr("quality >= 0.72 and cases >= 2 and laws >= 1"), F.expr("quality >= 0.45")
    ladder = lambda *v: F.when(strong, v[0]).when(fair, v[1]).when(F.col("cases") > 0, v[2]).otherwise(v[3])
    return q.select("place", "cases", "laws", "quality", ladder("strong", "moderate", "thin", "insufficient").alias("status"), ladder(0.84, 0.68, 0.45, 0.25).alias("confidence"))


_LABELS = {"en": r"\b(the|of)\b", "fr": r"\b(le|la|les)\b", "es": r"\b(el|los|las)\b"}


@book.add("""WITH d AS (SELECT doc_id, lower(coalesce(lang, '')) AS g, lower(text) AS x FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, label, starts_with(g, label)::INT AS gold, (CASE label """ + " ".join(f"WHEN '{k}' THEN regexp_matches(x, '{p}')" for k, p in _LABELS.items()) + """ END)::INT AS guess FROM d, (VALUES ('en'), ('fr'), ('es')) l(label)),
    p AS (SELECT doc_id, bool_and(gold = guess)::INT AS same FROM m GROUP BY 1), c AS (SELECT label, sum(gold * guess) AS tp, sum((1 - gold) * guess) AS fp, sum(gold * (1 - guess)) AS fn, sum((1 - gold) * (1 - guess)) AS tn FROM m GROUP BY 1),
    t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro FROM c), k AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS pe FROM t)
    SELECT round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(macro, 6) AS macro_f1, round((fp + fn) / n, 6) AS hamming_loss, round((po - pe) / (1 - pe), 6) AS kappa, (SELECT round(avg(same), 6) FROM p) AS exact_match FROM k""")
def a26_all_label_measures(t: Tables) -> DataFrame:
    """Micro, macro, exact match, Hamming loss and kappa over all decisions of several labels."""
    low, body = F.lower(F.coalesce("lang", F.lit(""))), F.lower("text")
    gold = {k: low.startswith(k).cast("int") for k in _LABELS}
    guess = {k: body.rlike(p).cast("int") for k, p in _LABELS.items()}
    marks = t.documents.filter("text is not null").select(*[gold[k].alias(f"g_{k}") for k in _LABELS], *[guess[k].alias(f"p_{k}") for k in _LABELS])
    # one row of counts, from which all measures follow
    same = F.lit(True)
    for k in _LABELS:
        same = same & (F.col(f"g_{k}") == F.col(f"p_{k}"))
    cells = [F.sum((F.col(f"g_{k}") == g).cast("int") * (F.col(f"p_{k}") == p).cast("int")).alias(f"{n}_{k}") for k in _LABELS for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    c = marks.agg(*cells, F.avg(same.cast("int")).alias("exact"))
    total = {n: sum((F.col(f"{n}_{k}") for k in _LABELS), F.lit(0)) for n in ("tp", "fp", "fn", "tn")}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = [ratio(2 * F.col(f"tp_{k}"), 2 * F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col(f"fn_{k}")) for k in _LABELS]
    tp, fp, fn, tn = total["tp"], total["fp"], total["fn"], total["tn"]
    n = tp + fp + fn + tn
    agreed, chance = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    r = lambda x, name: F.round(x, 6).alias(name)
    return c.select(r(ratio(tp, tp + fp), "micro_precision"), r(ratio(tp, tp + fn), "micro_recall"), r(ratio(2 * tp, 2 * tp + fp + fn), "micro_f1"), r(sum(f1, F.lit(0.0)) / len(f1), "macro_f1"), r((fp + fn) / n, "hamming_loss"), r((agreed - chance) / (1 - chance), "kappa"), r(F.col("exact"), "exact_match"))


@book.add("""WITH c AS (SELECT k.case_item_id, avg((coalesce(trim(evidence_excerpt), '') <> '')::INT) AS e, avg((law_id IS NOT NULL)::INT) AS l, avg(coalesce(match_score, 0)) AS s, avg((coalesce(match_source, '') IN ('pending', 'ocr'))::INT) AS o FROM canada_case_law_links k GROUP BY 1),
    p AS (SELECT c.*, ((i.published_at IS NOT NULL)::INT + (coalesce(json_extract_string(i.raw_json, '$.court_code'), '') <> '')::INT) / 2.0 AS p FROM c JOIN source_items i ON i.id = c.case_item_id)
    SELECT case_item_id, round(1 / (1 + exp(-4 * ((0.25 * e + 0.25 * l + 0.2 * s + 0.15 * p + 0.15 * (1 - o))::DOUBLE - 0.5))), 4) AS strength FROM p""")
def k15_case_strength_of_five(t: Tables) -> DataFrame:
    """Five inputs of their own: excerpts, resolved laws, scores, date and court, and what is not yet sure."""
    c = t.canada_case_law_links.groupBy("case_item_id").agg(F.avg((F.trim(F.coalesce("evidence_excerpt", F.lit(""))) != "").cast("int")).alias("e"), F.avg(F.col("law_id").isNotNull().cast("int")).alias("l"), F.avg(F.coalesce("match_score", F.lit(0.0))).alias("s"), F.avg(F.coalesce("match_source", F.lit("")).isin("pending", "ocr").cast("int")).alias("o"))
    p = (F.col("published_at").isNotNull().cast("int") + (F.coalesce(F.get_json_object("raw_json", "$.court_code"), F.lit("")) != "").cast("int")) / 2.0
    rows = c.join(t.source_items.select(F.col("id").alias("case_item_id"), p.alias("p")), "case_item_id")
    return rows.select("case_item_id", F.round(S.sigmoid(0.25 * F.col("e") + 0.25 * F.col("l") + 0.2 * F.col("s") + 0.15 * F.col("p") + 0.15 * (1 - F.col("o"))), 4).alias("strength"))


@book.add("""WITH c AS (SELECT case_item_id, count(*) FILTER (WHERE coalesce(match_source, '') IN ('pending', 'ocr')) AS warnings, count(*) FILTER (WHERE law_id IS NULL) AS risks, avg(coalesce(match_score, 0)) AS conf, count(DISTINCT law_id) AS laws FROM canada_case_law_links GROUP BY 1)
    SELECT case_item_id, CASE WHEN laws = 0 OR warnings >= 2 OR risks >= 4 OR conf < 0.35 THEN 'high' WHEN warnings = 1 OR risks >= 2 OR conf < 0.55 THEN 'medium' ELSE 'low' END AS level, 'case:' || case_item_id AS label FROM c""")
def r44_case_risk(t: Tables) -> DataFrame:
    """The ladder over a case's own links: none resolved, unsure sources, unresolved aliases, mean score."""
    c = t.canada_case_law_links.groupBy("case_item_id").agg(F.count_if(F.coalesce("match_source", F.lit("")).isin("pending", "ocr")).alias("w"), F.count_if(F.col("law_id").isNull()).alias("r"), F.avg(F.coalesce("match_score", F.lit(0.0))).alias("c"), F.count_distinct("law_id").alias("laws"))
    level = F.when(F.expr("laws = 0 or w >= 2 or r >= 4 or c < 0.35"), "high").when(F.expr("w = 1 or r >= 2 or c < 0.55"), "medium").otherwise("low")
    return c.select("case_item_id", level.alias("level"), F.concat(F.lit("case:"), F.col("case_item_id").cast("string")).alias("label"))


@book.add("""WITH r AS (SELECT law_id, case_item_id, max(coalesce(match_score, 0)) AS m FROM canada_case_law_links WHERE law_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY m DESC, case_item_id) AS place, count(*) OVER (PARTITION BY law_id) AS cases FROM r)
    SELECT g.law_id, l.title, g.case_item_id, round(g.m, 4) AS score, CAST(g.place AS INT) AS place, g.cases FROM g JOIN canada_laws l ON l.id = g.law_id""")
def k01_packet_rows(t: Tables) -> DataFrame:
    """Every case of every law with its place, as rows instead of one list; counts are combined before the shuffle."""
    r = t.canada_case_law_links.filter("law_id is not null").groupBy("law_id", "case_item_id").agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("m"))
    place = F.row_number().over(Window.partitionBy("law_id").orderBy(F.desc("m"), "case_item_id"))
    cases = r.groupBy("law_id").agg(F.count(F.lit(1)).alias("cases"))
    laws = t.canada_laws.select(F.col("id").alias("law_id"), "title").join(cases, "law_id")
    return r.withColumn("place", place).join(laws, "law_id").select("law_id", "title", "case_item_id", F.round("m", 4).alias("score"), "place", "cases")


@book.add("""WITH g AS (SELECT source_table, source_id, id, coalesce(jurisdiction, '') IN ('Ontario', 'Canada') AS ok FROM rag_chunks) SELECT source_table, source_id, id FROM g WHERE ok""")
def p15_granted_rows(t: Tables) -> DataFrame:
    """The chunks of every bundle that may be shown, a row each."""
    return t.rag_chunks.filter(F.coalesce("jurisdiction", F.lit("")).isin("Ontario", "Canada")).select("source_table", "source_id", "id")


_PHRASE = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


@book.add(f"""WITH x AS (SELECT id, ' ' || {_PHRASE.format("concat_ws(' ', title, summary, raw_text)")} || ' ' AS t FROM source_items UNION ALL SELECT case_item_id, ' ' || {_PHRASE.format('evidence_excerpt')} || ' ' FROM canada_case_law_links WHERE case_item_id IS NOT NULL),
    a AS (SELECT id AS law_id, origin = 'official' AS official, 'title' AS how, title AS name FROM canada_laws UNION ALL SELECT id, origin = 'official', 'citation', citation FROM canada_laws UNION ALL SELECT id, origin = 'official', 'alias', unnest(from_json(aliases_json, '["VARCHAR"]')) FROM canada_laws),
    n AS (SELECT law_id, official, how, {_PHRASE.format('name')} AS p FROM a WHERE name IS NOT NULL), m AS (SELECT x.id AS case_item_id, law_id, official, how, count(*) AS occ FROM x JOIN (SELECT DISTINCT * FROM n WHERE length(p) >= 6) n ON contains(x.t, ' ' || n.p || ' ') GROUP BY ALL),
    s AS (SELECT *, round(least(0.99, CASE how WHEN 'title' THEN CASE WHEN official THEN 0.97 ELSE 0.88 END WHEN 'citation' THEN 0.95 ELSE CASE WHEN official THEN 0.92 ELSE 0.83 END END + least(0.03, 0.01 * (occ - 1)))::DOUBLE, 4) AS score FROM m)
    SELECT case_item_id, law_id, max(score) AS score, CAST(sum(occ) AS BIGINT) AS occurrences FROM s GROUP BY 1, 2""")
def r34_names_to_links(t: Tables) -> DataFrame:
    """Titles, citations and aliases of all laws found as phrases in a case's texts and excerpts, scored; the best form of each law counts."""
    cases = t.source_items.select(F.lit("case").alias("kind"), "id", F.concat_ws(" ", "title", "summary", "raw_text").alias("text"))
    excerpts = t.canada_case_law_links.filter("case_item_id is not null").select(F.lit("excerpt").alias("kind"), F.col("id").alias("id"), F.col("evidence_excerpt").alias("text"))
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    forms = F.concat(F.array(F.struct(F.lit("title").alias("how"), F.col("title").alias("name")), F.struct(F.lit("citation").alias("how"), F.col("citation").alias("name"))), F.transform(aliases, lambda x: F.struct(F.lit("alias").alias("how"), x.alias("name"))))
    names = t.canada_laws.select(F.col("id").alias("law_id"), (F.col("origin") == "official").alias("official"), F.explode(forms).alias("f")).select("law_id", "official", "f.how", D.phrase(F.col("f.name")).alias("p")).filter(F.length("p") >= 6).distinct()
    listed = names.select(F.to_json(F.struct("law_id", "official", "how", "p")).alias("name_id"), F.col("p").alias("name"))
    hits = D.names_in_text(cases.unionByName(excerpts), listed)
    # an excerpt belongs to its link's case
    of = t.canada_case_law_links.select(F.col("id"), "case_item_id")
    told = hits.filter("kind = 'case'").select(F.col("id").alias("case_item_id"), "name_id").unionByName(hits.filter("kind = 'excerpt'").join(of, "id").select("case_item_id", "name_id"))
    r = F.from_json("name_id", "law_id bigint, official boolean, how string, p string")
    found = told.groupBy("case_item_id", r.alias("r")).agg(F.count(F.lit(1)).alias("n")).groupBy("case_item_id", "r.law_id", "r.official", "r.how").agg(F.sum("n").alias("occ"))
    base = F.when(F.col("how") == "title", F.when(F.col("official"), 0.97).otherwise(0.88)).when(F.col("how") == "citation", 0.95).otherwise(F.when(F.col("official"), 0.92).otherwise(0.83))
    score = F.round(F.least(F.lit(0.99), base + F.least(F.lit(0.03), 0.01 * (F.col("occ") - 1))), 4)
    return found.groupBy("case_item_id", "law_id").agg(F.max(score).alias("score"), F.sum("occ").alias("occurrences"))
