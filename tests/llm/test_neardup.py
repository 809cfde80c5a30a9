import random

from pyspark.sql import functions as F

from docketry.llm.neardup import candidates, content, expand_pairs, near_duplicates, shingles, signature, tokens


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus():
    rng = random.Random(1)
    rows, k = [], 0
    for _ in range(30):
        base = words(rng, rng.randrange(60, 200))
        for share in (0.0, 0.02, 0.06, 0.15):
            text = [w if rng.random() > share else f"x{rng.randrange(999)}" for w in base]
            rows.append((k, "T", " ".join(text)))
            k += 1
        rows.append((k, "T", " ".join(base)))
        k += 1
    return rows


def brute(rows, least=40):
    sets = {}
    for k, t, r in rows:
        w = tokens((t or "") + " " + (r or ""))
        if len(w) >= least:
            sets[k] = set(zip(w, w[1:], w[2:]))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, title string, raw_text string").withColumn("_id", F.lit(1)).withColumn("_class", F.lit("x"))
    members, pairs = near_duplicates(df, "id", content())
    return {(r["item_a"], r["item_b"]) for r in expand_pairs(members, pairs, "id").collect()}


def test_tokens():
    assert tokens("Été n° 5, l’an_2 法院A") == ["été", "n", "5", "l", "an", "2", "法", "院", "a"]
    assert shingles("a b c") is None and shingles("a b", least=0) is None


def test_pairs_match_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    text = " ".join(words(random.Random(2), 50))
    rows = [(1, None, None), (2, "", ""), (3, "t", text), (4, "t", text), (4, "t", text), (5, "T", text.upper()), (6, None, "short"), (7, "t", text + " " + " ".join(f"q{i}" for i in range(20_000)))]
    assert found(spark, rows) == {(3, 4), (3, 5), (4, 5)}
    assert found(spark, rows[:2]) == set()


def test_candidates_count_all_agreements(spark):
    rng = random.Random(4)
    sigs = [(i, [j * 1000 + rng.randrange(4) for j in range(12)]) for i in range(60)]
    df = spark.createDataFrame(sigs, "_id bigint, _sig array<bigint>")
    for m in (1, 2, 5, 8):
        slow = {(a, b) for a, x in sigs for b, y in sigs if a < b and sum(p == q for p, q in zip(x, y)) >= m}
        for long in (2_000, 5):
            assert {(r["_a"], r["_b"]) for r in candidates(df, 12, m, long).collect()} == slow


def test_a_phrase_in_every_record(spark):
    phrase = " ".join(f"stock{i}" for i in range(25))
    rows = [(k, t, f"{phrase} {r}") for k, t, r in corpus()] + [(k + 1000, "U", f"{phrase} " + " ".join(words(random.Random(k), 60))) for k in range(60)]
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_signature_estimates_similarity():
    rng = random.Random(5)
    a = words(rng, 400)
    b = a[:300] + words(rng, 100)
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    true = len(set(x) & set(y)) / len(set(x) | set(y))
    agree = (signature(x, 400, 1) == signature(y, 400, 1)).mean()
    assert abs(agree - true) < 0.1
