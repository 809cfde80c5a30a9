import math

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import vectors
from docketry.llm.vectors import block_join, exact_product, most_similar, pairs_found, quantised

SCHEMA = "chunk_id bigint, embedding_model string, dimension int, embedding_vector array<float>"


def brute(rows, k, least=-1.0):
    good = {}
    for i, m, d, v in rows:
        if v is not None and len(v) == d and d and all(x is not None and not math.isnan(x) for x in v) and any(v):
            good[i] = (m, np.array(v, dtype=np.float32).astype(float))
    out = set()
    for i, (m, v) in good.items():
        c = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, (n, w) in good.items() if n == m and j != i]
        out |= {(i, j, -s) for s, j in sorted(x for x in c if -x[0] >= least)[:k]}
    return out


def run(spark, rows, k=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit("x")).withColumn("rank", F.lit(0))
    return {(r["chunk_id"], r["neighbour"], r["cosine"]) for r in most_similar(df, "chunk_id", k, **more).collect()}


def sample(n=120, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    return [(i, "a" if i % 3 else "b", dims, [float(np.float32(x)) for x in centre[i % 6] + 0.5 * rng.normal(size=dims)]) for i in range(n)]


def test_exact_with_all_cells(spark):
    rows = sample()
    assert run(spark, rows, cell=30, probes=99) == brute(rows, 3)
    assert run(spark, rows, least=0.8, cell=30, probes=99) == brute(rows, 3, 0.8)


def test_edges(spark):
    rows = sample(12)
    same = [float(np.float32(x)) for x in np.linspace(1, 2, 16)]
    rows += [(100 + i, "a", 16, same) for i in range(9)] + [(200, "a", 16, [2 * x for x in same])]
    rows += [(300, "a", 16, None), (301, "a", 16, [0.0] * 16), (302, "a", 16, [float("nan")] * 16), (303, "a", 16, same[:8]), (304, None, 16, same), (305, "a", None, same)]
    assert run(spark, rows, cell=5, probes=99) == brute([r for r in rows if r[0] not in (304, 305)], 3)
    assert run(spark, rows[:0]) == set()


def test_block_join_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    r, d, c = block_join(x, x, np.arange(300), 4, -1.0, tile=64)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.sort(np.round(u @ u.T, 6), axis=1)[:, ::-1][:, :4]
    assert np.abs(c.reshape(-1, 4) - want).max() < 2e-6
    q, e = quantised(u.astype(np.float32), 1.0)
    assert (np.linalg.norm(u - q / 127.0, axis=1) <= e + 1e-5).all()


def test_recall_with_few_cells(spark):
    rows = sample(600, 16, 2)
    want = {(min(a, b), max(a, b)) for a, b, _ in brute(rows, 3, 0.7)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["chunk_a"], r["chunk_b"]) for r in pairs_found(most_similar(df, "chunk_id", 3, 0.7, cell=60, probes=4), "chunk_id").collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_product_is_exact():
    assert exact_product(vectors._product()) and exact_product(vectors._float_product)

    def saturating(a, b):
        a, b = a.astype(np.int32), b.astype(np.int32)
        if a.shape[1] % 2:
            return a @ b.T
        pairs = a[:, None, ::2] * b[None, :, ::2] + a[:, None, 1::2] * b[None, :, 1::2]
        return pairs.clip(-8000, 8000).sum(axis=2)

    assert not exact_product(saturating)


def test_extreme_rows():
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], (200, 256)).astype(np.float32)
    r, d, c = block_join(x, x, np.arange(200), 3, -1.0, tile=50)
    u = x.astype(float) / 16
    all_ = np.round(u @ u.T, 6)
    want = [sorted((-all_[i, j], j) for j in range(200))[:3] for i in range(200)]
    assert [(-v, j) for v, j in zip(c, d)] == [x for w in want for x in w]


def test_parts_slices_and_kinds(spark, monkeypatch):
    rows = sample(150)
    want = brute(rows, 3)
    monkeypatch.setattr(vectors, "PART_BYTES", 600)
    assert run(spark, rows, cell=12, probes=99) == want
    monkeypatch.setattr(vectors, "PART_BYTES", 1 << 20)
    monkeypatch.setattr(vectors, "MOST_KINDS", 1)
    monkeypatch.setattr(vectors, "PENDING", 10)
    assert run(spark, rows, cell=30, probes=99) == want


def test_many_copies(spark, monkeypatch):
    same = [float(x) for x in range(1, 17)]
    rows = sample(60) + [(1000 + i, "a", 16, same) for i in range(70)] + [(2000 + i, "b", 16, same) for i in range(9)]
    want = brute(rows, 3)
    assert run(spark, rows, cell=20, probes=99) == want
    monkeypatch.setattr(vectors, "MOST_COPIED", 0)
    assert run(spark, rows, cell=20, probes=99) == want
