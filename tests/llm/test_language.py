import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm.language import LANGUAGES, Model, detect, fit, label, languages_of, lines, normal, pieces, train

LINES = {
    "en": "the court held that the lease was not void and the tenant shall pay the costs of the hearing",
    "fr": "la cour a conclu que le bail n'est pas nul et que le locataire doit payer les frais de l'audience",
    "es": "el tribunal concluyó que el contrato no es nulo y que el inquilino debe pagar las costas de la audiencia",
    "de": "das gericht hat entschieden dass der vertrag nicht nichtig ist und der mieter die kosten zahlen muss",
    "pt": "o tribunal concluiu que o contrato não é nulo e que o inquilino deve pagar as custas da audiência",
    "zh": "法院认为该合同有效，租客应当支付听证会的费用。",
}


def sentence(lang, rng):
    if lang == "zh":
        return "".join(rng.sample(LINES["zh"], len(LINES["zh"])))
    w = LINES[lang].split()
    return " ".join(rng.choice(w) for _ in range(12))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(sentence(x, rng), x) for x in LANGUAGES for _ in range(60)]
    rows += [(sentence("fr", rng), "en") for _ in range(6)]
    return fit(rows, pieces())


def test_forward_sums_all_segmentations():
    v = {"▁a": 0, "b": 1, "▁ab": 2, "c": 3, "bc": 4}
    p = np.array([[0.1, 0.2], [0.3, 0.1], [0.05, 0.3], [0.2, 0.2], [0.1, 0.05]])
    m = Model(v, p, ("x", "y"))
    got = m.forward("abc")
    for k in (0, 1):
        want = p[0, k] * p[1, k] * p[3, k] + p[2, k] * p[3, k] + p[0, k] * p[4, k]
        assert abs(got[k] - math.log(want)) < 1e-3


def test_labels_and_lines():
    assert [label(x) for x in (None, " ", "und", "EN-ca", "fr_CA", "mul", "Unknown", "it")] == ["", "", "", "en", "fr", "", "", "it"]
    assert lines("a\r\n\n  \nb") == ["a", "b"] and normal("ÉTÉ <b>x</b>").split() == ["ete", "x"]


def test_held_out_accuracy(model):
    rng = random.Random(9)
    tests = [(x, sentence(x, rng)) for x in LANGUAGES for _ in range(40)]
    tests += [(x, sentence(x, rng).upper()) for x in LANGUAGES for _ in range(10)]
    right = sum(LANGUAGES[detect(model, t)[0]] == x for x, t in tests)
    assert right >= 0.99 * len(tests)


def test_operator(spark, model):
    rng = random.Random(3)
    en, fr = sentence("en", rng), sentence("fr", rng)
    rows = [(1, en, "en-CA"), (2, fr, "en"), (3, en + "\r\n\n" + en + "\n" + fr, "en"), (4, None, "en"), (5, " ", None), (6, "*** 12 [3]", "en"), (7, "COSTS\n" + en, None), (8, (en + "\n") * 3000, "en"), (1, en, "en-CA")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("_text", F.lit("x")).withColumn("seg_no", F.lit("y"))
    got = languages_of(df, model, "doc_id").collect()
    whole = {r["doc_id"]: r["lang"] for r in got if r["seg_no"] == -1}
    assert whole == {1: "en", 2: "fr", 3: "en", 7: "en", 8: "en"}
    assert sorted((r["seg_no"], r["lang"]) for r in got if r["seg_no"] >= 0) == [(0, "en"), (1, "en"), (2, "fr")]
    assert {r["doc_id"] for r in got if r["seg_no"] >= 0} == {3}
    assert all(0 <= r["confidence"] <= 1 for r in got)
    assert sum(r["doc_id"] == 1 for r in got) == 2
    assert languages_of(df.limit(0), model, "doc_id").count() == 0


def test_train_on_a_bounded_sample(spark):
    rng = random.Random(5)
    rows = [(i, sentence(x, rng), x) for i, x in enumerate(LANGUAGES * 30)] + [(999, None, "en"), (1000, "x", None)]
    m = train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), each=20)
    assert LANGUAGES[detect(m, LINES["de"])[0]] == "de"
    empty = train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert detect(empty, "any words here") is not None
