import math
import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import planner as P
from docketry.functions import vectors as VX
from docketry.operators import assembly as A
from docketry.operators import fulltext as T
from docketry.operators import relational as R
from docketry.sources import files

TEXTS = [(1, "The easement and the lease."), (2, "lease Lease; no other word"), (3, "costs fixed. The lease ended"), (4, None), (5, ""), (6, "l'appel de Montréal"), (7, "fixed costs"), (8, "word " * 5000 + "easement")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id bigint, x string").withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("term", F.lit("clash"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_parse():
    assert T.parse("") == [] and T.parse("-a") == [] and T.parse("or OR") == []
    g = T.parse('Lease -"two words" or l\'appel')
    assert g == [T.Group([("lease",)], [("two", "words")]), T.Group([("l", "appel")])]
    assert T.fallback_terms("the lease the costs", {"the"}) == ["lease", "costs"] and T.fallback_terms("the", {"the"}) == ["the"]


@pytest.mark.parametrize(
    ("query", "want"),
    [("lease", [1, 2, 3]), ("easement lease", [1]), ('"costs fixed"', [3]), ('"fixed costs" or easement', [1, 7, 8]), ("lease -easement", [2, 3]), ("l'appel", [6]), ("MONTRÉAL", [6]), ("nothing", []), ("-lease", []), ("", [])],
)
def test_match(docs, query, want):
    index = T.index(docs, "id", "x")
    assert ids(T.match(index, "id", query)) == want


def test_scores_and_fallback(docs):
    index = T.index(docs, "id", "x")
    assert {r["id"]: r["score"] for r in T.match(index, "id", "lease").collect()} == {1: 1.0, 2: round(1 + math.log(2), 6), 3: 1.0}
    assert ids(T.search(index, docs, "id", "easement zzzz lease")) == [1]
    assert ids(T.search(index, docs, "id", "lease costs", F.col("id") < 3)) == []
    assert ids(T.search(index, docs, "id", "")) == []
    assert ids(T.match(T.index(docs.limit(0), "id", "x"), "id", "lease")) == []


def test_kept_index_reads_only_its_terms(spark, docs):
    kept = T.keep(T.index(docs, "id", "x"))
    found = T.match(kept, "id", '"costs fixed"')
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [costs,fixed])]" in plan.replace("IsNotNull(term), ", "")
    assert ids(found) == [3]


def test_dictionaries(spark):
    df = spark.createDataFrame([(1, "抵押合同违约"), (2, None), (3, "抵押 抵押"), (4, "x" * 10_000)], "id int, x string")
    got = {r["id"]: r["f"] for r in df.select("id", L.translated(F.col("x"), P.GLOSSARY).alias("f")).collect()}
    assert got == {1: ["mortgage contract", "breach"], 2: [], 3: ["mortgage"], 4: []}
    assert [en for _, en in P.translate("抵押合同违约")] == got[1]
    for text in ("2001 BCXC 4", "Smith v. Jones", "compare both", "what now", "plain words"):
        assert spark.range(1).select(L.intent(F.lit(text)).alias("i")).first()["i"] == P.intent(text)
    names = spark.createDataFrame([("supreme court", "SCC")], "alias string, canonical string")
    rows = spark.createDataFrame([(1, " Supreme  Court "), (2, "other"), (3, None), (4, "  ")], "id int, a string")
    assert {r["id"]: r["c"] for r in L.canonical(rows, F.col("a"), names, "c").collect()} == {1: "SCC", 2: "raw:other", 3: "", 4: ""}


def test_query_graph():
    edges = P.query_edges('Can a landlord in Ontario end a lease? "notice to quit"')
    assert ("query", "place", "Ontario", 1.0) in edges and ("query", "quoted", "notice to quit", 1.35) in edges
    assert P.query_edges("") == []


def test_vector_scores(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r["id"]: (r["c"], r["h"]) for r in df.select("id", VX.cosine_to([1.0, 1.0], F.col("v")).alias("c"), VX.hamming_to([1.0, 1.0], F.col("v")).alias("h")).collect()}
    assert got[1] == (0.707107, 1) and got[2] == (0.707107, 1) and got[3] == (-1.0, 2)
    assert all(got[i] == (None, None) for i in (4, 5, 6, 7, 8, 9))
    assert df.limit(0).select(VX.cosine_to([1.0], F.col("v"))).count() == 0


def test_similar_and_sharing_sets(spark):
    rng = random.Random(2)
    sets = {k: {0} | {rng.randrange(1, 14) for _ in range(rng.randrange(1, 9))} for k in range(60)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s] * 2 + [(None, 1), (3, None)], "k bigint, i bigint")
    for least in (0.5, 0.714, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-9}
        assert {(r["a"], r["b"]) for r in R.similar_sets(df, "k", "i", least).collect()} == want
    left, right = df.withColumnRenamed("k", "l"), df.filter("k < 20").withColumnRenamed("k", "r")
    for least in (1, 3):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if b < 20 and len(sets[a] & sets[b]) >= least}
        assert {(r["l"], r["r"], r["common"]) for r in R.sharing_sets(left, right, "l", "r", "i", least).collect()} == want


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 1, 9)] + [("b", 2.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["g"]: (r["p0"], r["p50"], r["p99"]) for r in R.floor_percentiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (1.0, 1.0, 9.0), "b": (2.0, 2.0, 2.0)}


def test_numbered_and_sampled(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert all(r["id"] == r["number"] for r in A.numbered(df, "id").collect())
    assert A.numbered(df.limit(0), "id").count() == 0
    some = ids(A.sampled(df, "id", 0.3, "s"))
    assert some == ids(A.sampled(df.repartition(7), "id", 0.3, "s")) and 200 < len(some) < 400
    assert A.sampled(df, "id", 1.0).count() == 1000 and A.sampled(df, "id", 0.0).count() == 0


def test_queue(spark):
    rows = [(1, "running", 1.0, "a", 0), (2, "running", 1.0, "b", 950), (3, "pending", 5.0, None, None), (4, "pending", None, None, None), (5, "done", 9.0, "c", 1), (6, "running", 2.0, "d", None)]
    df = spark.createDataFrame(rows, "id int, state string, priority double, owner string, at int").withColumn("leased_at", F.timestamp_seconds("at"))
    got = {r["id"]: (r["state"], r["owner"]) for r in A.requeue_and_claim(df, F.timestamp_seconds(F.lit(1000)), 600, 2, "me").collect()}
    assert got == {1: ("pending", None), 2: ("running", "b"), 3: ("running", "me"), 4: ("pending", None), 5: ("done", "c"), 6: ("running", "me")}


def test_signatures(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 7), ("c", 4, 8)], "code string, id int, updated_at int")
    old = A.signature(df.filter("id in (1, 2, 3)").unionByName(spark.createDataFrame([("b", 9, 9), ("d", 1, 1)], df.schema)), ["code"])
    assert {r["code"]: r["state"] for r in A.changed_since(A.signature(df, ["code"]), old, ["code"]).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "gone"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id, name\n1,-0-\n2,\"two\nlines, \"\"quoted\"\"\"\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), nothing="-0-").collect()
    assert [r.asDict() for r in rows] == [{"id": "1", "name": ""}, {"id": "2", "name": 'two\nlines, "quoted"'}]
    df = spark.range(50).withColumn("x", F.lit("y"))
    files.write_archive(df, "id", str(tmp_path / "archive"))
    assert ids(files.read_archive(spark, str(tmp_path / "archive"), "id bigint, x string")) == list(range(50))
    files.write_ordered(df.repartition(5), "id", str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [int(line.split(":")[1].split(",")[0]) for line in lines] == list(range(50))
