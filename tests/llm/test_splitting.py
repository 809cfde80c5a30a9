import random

import pytest
from pyspark.sql import functions as F

from docketry.llm.splitting import boundary, split_files, split_text


def check(pieces, text, limit, overlap):
    """pieces: (index, start, piece) in order."""
    whole = ""
    for i, (no, start, piece) in enumerate(pieces):
        assert no == i and 0 < len(piece) <= limit
        assert text[start : start + len(piece)] == piece
        if i:
            assert piece[:overlap] == whole[len(whole) - overlap :]
            whole += piece[overlap:]
        else:
            whole += piece
    assert whole == text


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(["\n\n", "\nPART II – FACTS\n\n", "\n(a) ", ". ", "。", " ", "é", "\r\n", ", ", "word ", "法院", "x" * rng.randrange(60)]))
    return "".join(out)[:n]


@pytest.mark.parametrize("span", [1 << 20, 2_000])
def test_round_trip(spark, span):
    texts = {1: prose(9_000), 2: "x" * 7_001, 3: "法" * 5_000, 4: None, 5: "", 6: "y" * 600, 7: prose(30_000, 3), 8: " \n" * 4_000}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "id bigint, t string").withColumn("_text", F.lit("z")).withColumn("start", F.lit(1))
    rows = split_text(df, ["id"], "t", 600, 50, span).collect()
    assert {r["id"] for r in rows} == {1, 2, 3, 7, 8}
    for k in (1, 2, 3, 7, 8):
        check(sorted((r["chunk_index"], r["start"], r["piece"]) for r in rows if r["id"] == k), texts[k], 600, 50)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, prose(5_000)), (1, prose(5_000))], "id bigint, t string")
    assert split_text(df, ["id"], "t", 600, 50, pieces=False).columns == ["id", "chunk_index", "start", "length"]
    for span in (1 << 20, 1_500, None):
        rows = split_text(df, ["id"], "t", 600, 50, span).collect()
        assert len(rows) == 2 * len({r["chunk_index"] for r in rows})
    assert split_text(df.limit(0), ["id"], "t", 600, 50).count() == 0
    with pytest.raises(ValueError):
        split_text(df, ["id"], "t", 100, 60)


def test_natural_boundaries():
    text = "a" * 60 + ". B" + "c" * 20 + "\n\n" + "d" * 30 + " " + "e" * 40
    assert text[boundary(text, 40, 110) :].startswith("d")
    assert boundary("z" * 300, 100, 200) == 200
    assert text[boundary(text, 40, 70) :].startswith("B")


@pytest.mark.parametrize("span", [1 << 20, 3_001])
def test_files(spark, tmp_path, span):
    texts = {"a.txt": prose(40_000, 5), "b.txt": "法" * 9_000, "c.txt": "short", "d.txt": ""}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    rows = split_files(spark, [str(tmp_path / n) for n in texts], 600, 50, span).collect()
    for n, t in texts.items():
        check(sorted((r["chunk_index"], r["start"], r["piece"]) for r in rows if r["path"].endswith(n)), t, 600, 50)
