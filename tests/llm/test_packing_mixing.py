import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm.mixing import mix, mix_plan, mix_report
from docketry.llm.packing import pack, sum_of_squares
from docketry.llm.tokens import encoding, token_sizes


def test_sum_of_squares_fits():
    rng = random.Random(1)
    sizes = np.array(sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True))
    where = sum_of_squares(sizes, 128)
    loads = np.bincount(where, weights=sizes)
    assert loads.max() <= 128 and loads.min() > 0 and len(loads) <= 1.05 * -(-sizes.sum() // 128) + 1
    assert list(sum_of_squares(np.array([5, 5, 5]), 5)) == [0, 1, 2]
    assert len(sum_of_squares(np.array([], dtype=int), 5)) == 0


def test_pack(spark):
    rows = [(1, 10), (2, 250), (3, 100), (4, None), (5, 0), (6, -3), (7, 40), (7, 40), (8, 101)]
    sizes = spark.createDataFrame(rows, "id bigint, n_tokens bigint").withColumn("part", F.lit("x")).withColumn("profile", F.lit("y"))
    limits = spark.createDataFrame([("s", 100), ("l", 1000), ("none", 0)], "profile string, capacity_tokens int")
    got = pack(sizes, limits, "id").collect()
    for p, cap in (("s", 100), ("l", 1000)):
        mine = [r for r in got if r["profile"] == p]
        load, total, parts = {}, {}, {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
            total[r["id"]] = total.get(r["id"], 0) + r["n_tokens"]
            parts.setdefault(r["id"], []).append(r["part"])
        assert max(load.values()) <= cap
        assert total == {1: 10, 2: 250, 3: 100, 7: 80, 8: 101}
        assert sorted(parts[2]) == ([0, 1, 2] if cap == 100 else [0])
    assert {r["profile"] for r in got} == {"s", "l"}
    assert pack(sizes.limit(0), limits, "id").count() == 0 and pack(sizes, limits.limit(0), "id").count() == 0


def test_blocks_keep_all_items(spark):
    sizes = spark.createDataFrame([(i, i % 37 + 1) for i in range(500)], "id bigint, n_tokens bigint")
    limits = spark.createDataFrame([("s", 64)], "profile string, capacity_tokens int")
    got = pack(sizes, limits, "id", block=50).collect()
    assert sorted(r["id"] for r in got) == list(range(500))


def test_token_sizes(spark):
    texts = [(1, "The court held. Été 法院 <|endoftext|>"), (2, None), (3, " \n "), (4, "a" * 200_000), (1, "x")]
    df = spark.createDataFrame(texts, "id bigint, t string").withColumn("n_tokens", F.lit("c"))
    got = sorted((r["id"], r["n_tokens"]) for r in token_sizes(df, "id", "t").collect())
    want = sorted((i, len(encoding().encode_ordinary(t))) for i, t in texts if t and t.strip())
    assert got == want


def sizes(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a"] * 12 + ["b"] * 3 + ["c"]), rng.randrange(20, 400), 1500) for i in range(2000)] + [(9001, None, 50, 200), (9002, "zzz", 50, 200)]
    return spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint, n_bytes bigint")


TARGETS = [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 4), ("n", "c", 35.0, 3), ("n", "nothing", 65.0, 9), ("n", "b", 65.0, 1)]


def test_mix_reaches_shares(spark):
    s, t = sizes(spark), spark.createDataFrame(TARGETS, "mix_name string, source string, target_weight double, max_repeats int")
    chosen = mix(s, t, "id")
    rows = {(r["mix_name"], r["source"]): r for r in mix_report(s, t, chosen).collect()}
    for k, want in {("m", "a"): 0.5, ("m", "b"): 0.3, ("m", "c"): 0.2, ("n", "c"): 0.35, ("n", "b"): 0.65}.items():
        assert abs(rows[k]["actual_share"] - want) < 0.01 and rows[k]["most_repeats"] <= rows[k]["max_repeats"], rows[k]
    assert rows["n", "nothing"]["actual_share"] == 0
    # whole epochs come before the part drawn: repeats differ by one at most in a source
    spread = chosen.groupBy("mix_name", "source").agg(F.max("repeats").alias("x"), F.min("repeats").alias("n")).collect()
    assert all(r["x"] - r["n"] <= 1 for r in spread)
    assert chosen.groupBy("mix_name", "id").count().filter("count > 1").count() == 0
    again = mix(s.repartition(7), t, "id")
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_mix_edges(spark):
    t = spark.createDataFrame([*TARGETS, ("m", "b", None, 2), ("z", "a", 0.0, 1)], "mix_name string, source string, target_weight double, max_repeats int")
    none = sizes(spark).limit(0)
    assert mix(none, t, "id").count() == 0 and {r["budget_tokens"] for r in mix_plan(none, t).collect()} == {0.0}
    assert mix(sizes(spark), t.limit(0), "id").count() == 0


@pytest.mark.parametrize("most", [1, 10_000])
def test_mix_joins_agree(spark, most):
    t = spark.createDataFrame(TARGETS, "mix_name string, source string, target_weight double, max_repeats int")
    got = mix(sizes(spark), t, "id", max_targets=most).agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0]
    assert got == mix(sizes(spark), t, "id").agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0]
