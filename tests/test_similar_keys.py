import itertools
import random

import duckdb

from docketry.operators import relational as R
from docketry.plans import q_relational as Q

NAME = "j11_pairwise_similarity"


def both_ways(spark, folder, events):
    """The query over a table of (ts, user_id, event_type), as a DataFrame, and the rows of its SQL."""
    con = duckdb.connect()
    con.execute(f"COPY ({events}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return Q.QUERIES[NAME](spark, str(folder)), sorted(con.execute(Q.ORACLE[NAME]).fetchall())


def most_rows(node):
    """The most rows that any operator of a plan that ran has put out."""
    kind = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_missing_types_and_times_make_no_feature(spark, tmp_path):
    rows = "('a', 1, 1), ('b', 1, 1), (NULL, 1, 1), ('a', 1, 2), ('b', NULL, 2), (NULL, 1, 3), ('a', NULL, 4), ('b', 1, NULL), ('b', 1, 5), (NULL, 7, 5)"
    df, expected = both_ways(spark, tmp_path, f"SELECT TIMESTAMP '2024-01-01' + to_hours(h) AS ts, CAST(u AS BIGINT) AS user_id, e AS event_type FROM (VALUES {rows}) v(e, h, u)")
    # users 3 and 4 have no feature at all: NaN in SQL, which is above any threshold
    assert repr(sorted(map(tuple, df.collect()))) == repr(expected) == "[(1, 2, 0.5), (1, 5, 0.5), (3, 4, nan)]"


def test_equal_sets_are_compared_once(spark, tmp_path):
    # 400 users, all with the same 20 features: no step makes more rows than there are pairs
    df, expected = both_ways(spark, tmp_path, "SELECT TIMESTAMP '2024-01-01' + to_hours(6 * h) AS ts, u AS user_id, chr(CAST(97 + e AS INT)) AS event_type FROM range(400) a(u), range(5) b(e), range(4) c(h)")
    got = sorted(map(tuple, df.collect()))
    assert got == expected and len(got) == 400 * 399 // 2
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= len(got)


def test_similar_keys_as_by_brute_force(spark):
    draw = random.Random(3)
    sets = {k: frozenset(draw.sample("abcdefgh", draw.randint(1, 4))) for k in draw.sample(range(-500, 500), 90)}
    rows = [(k, i) for k, s in sets.items() for i in s for _ in range(2)] + [(None, "a"), (1000, None)]
    got = R.similar_keys(spark.createDataFrame(rows, "k long, i string"), "k", "i", 0.4, 3, per=2).collect()
    expected = [(a, b, round(len(x & y) / len(x | y), 3)) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if len(x & y) / len(x | y) >= 0.4]
    assert len(set(sets.values())) < len(sets) and sorted(map(tuple, got)) == expected
