import random

from docketry.llm.canonical import Dictionary, cost, deletes, fitting, map_to_reference, parse, reference_rows

LAWS = [
    (1, "Kiln Quota Act, 1971", "kiln quota act, 1971", "S.C. 1971, c. 11", None),
    (2, "Kiln Quota Act, 1999", "kiln quota act, 1999", "S.C. 1999, c. 12", "[]"),
    (3, "Wharf Lighting Act", "wharf lighting act", "", '["Loi sur l\\u2019\\u00e9clairage des quais", "WLA"]'),
    (4, "Tannery Licensing Act", "tannery licensing act", None, "no json"),
    (5, "Tannery Licensing Regulations", "tannery licensing regulations", "SOR 77/12", None),
    (6, "Harbour Zoning Regulations", "harbour zoning regulations", None, None),
]
LAW_SCHEMA = "id bigint, title string, normalized_title string, citation string, aliases_json string"


def dictionary():
    names = ("id", "title", "normalized_title", "citation", "aliases_json")
    return Dictionary(reference_rows([dict(zip(names, r)) for r in LAWS]))


def ids(value):
    return [r[3] for r in fitting(dictionary().candidates(value))]


def test_forms_of_one_name():
    for v in ("Wharf Lighting Act", "the wharf lighting act, s. 4", "Lighting (Wharf) Act", "Act respecting lighting (wharf)", "WharfLightingAct", "Wharf  Ligthing Act", "Wharf Lighting", "Wharf Lighting Act, 1950", "WLA", "Loi sur l'eclairage des quais", "section 3, Wharf Lihgting Regulations", "Wharf Lighti..."):
        assert ids(v) == [3], v


def test_kind_and_year_choose():
    assert ids("Tannery Licensing Act") == [4] and ids("tannery licensing regs") == [5]
    assert ids("Kiln Qouta Act, 1999") == [2]
    assert len(ids("Kiln Quota Act")) == 2 and len(ids("Tannery Licensing")) == 2
    assert ids("SOR 77/12") == [5] and ids("sc 1971 c 11") == [1]


def test_other_words_are_no_misspellings():
    assert ids("Harbour Zonning Regulations") == [6]
    for v in ("ibid.", "???", "unknown statute", "Smith v. Jones", "s. 12", "", "   ", "Harbour Lighting Act"):
        assert ids(v) == [], v


def test_cost_and_deletes():
    assert cost("abcd", "abdc") < 1 and cost("abcd", "abcd") == 0 and cost("abcd", "wxyz") == 9
    assert deletes("abc", 1) == {"abc", "ab", "ac", "bc"}
    assert parse("").cores == {}


def test_near_matches_brute_force():
    d, rng = dictionary(), random.Random(3)
    for _ in range(200):
        word = list(d.terms[rng.randrange(d.whole_terms)])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word))
            word[i : i + 1] = rng.choice(["", word[i] * 2, rng.choice("abcdefgh")])
        word = "".join(word)
        if d.known(word):
            continue
        from docketry.llm.canonical import allowed

        slow = {i for i, t in enumerate(d.terms[: d.whole_terms]) if cost(word, t, allowed(len(word))) <= allowed(len(word)) and len(set(deletes(word, int(allowed(len(word))))) & set(deletes(t, int(allowed(len(t))))))}
        assert {i for i in d._near(word) if i < d.whole_terms} >= slow


def test_operator_edges(spark):
    laws = spark.createDataFrame(LAWS, LAW_SCHEMA)
    rows = [(1, "wharf lighting act", "x"), (1, "wharf lighting act", "x"), (2, None, None), (3, "   ", None), (4, "Kiln Quota Act", None), (5, "z" * 50_000, None), (6, "Harbour Zoning Regs", "_")]
    links = spark.createDataFrame(rows, "id bigint, alias string, law_id string")
    got = sorted((r["id"], r["law_id"], r["n_fit"]) for r in map_to_reference(links, laws, "id", "alias").collect())
    assert got == [(1, 3, 1), (1, 3, 1), (4, -1, 2), (5, -1, 0), (6, 6, 1)]
    assert map_to_reference(links.limit(0), laws, "id", "alias").count() == 0
    assert {r["law_id"] for r in map_to_reference(links, laws.limit(0), "id", "alias").collect()} == {-1}


def test_links_rank_what_fits_equally(spark):
    laws = spark.createDataFrame(LAWS, LAW_SCHEMA)
    links = spark.createDataFrame([(1, "Kiln Quota Act"), (2, "Wharf Lighting"), (3, "no such thing")], "id bigint, alias string")
    for linked, first in (([(2, 5), (1, 3)], 2), ([(2, 5), (1, 9)], 1), ([], 1)):
        counts = spark.createDataFrame(linked, "law_id bigint, n bigint")
        for bound in (20_000, 2):
            got = {r["id"]: (r["law_id"], r["n_fit"], r["nearest"]) for r in map_to_reference(links, laws, "id", "alias", counts, bound).collect()}
            assert got == {1: (-1, 2, first), 2: (3, 1, 3), 3: (-1, 0, None)}


def test_blocks_give_the_same(spark):
    more = [(7, "Kiln Quotas Act", "kiln quotas act", None, None), (8, "Wharf Lighting Rules", "wharf lighting rules", None, '["Wharf Lamps Rules"]'), (9, "Harbour Zonning Act, 1950", "harbour zonning act, 1950", None, None)]
    laws = spark.createDataFrame(LAWS + more, LAW_SCHEMA)
    names = ["Wharf Lighting Act", "Kiln Quota Act", "Tannery Licencing Act", "nothing", "Harbour Zonning Regs", "Kiln Quotaz Act", "Wharf Lihgting", "Wharf Lamps Rules", "WLA", "SOR 77/12", "Harbour Zoning", "Wharf Lighti...", "Tannery Licensing"]
    links = spark.createDataFrame([(i % 9, v) for i, v in enumerate(names * 2)], "id bigint, alias string")
    counts = spark.createDataFrame([(2, 4), (5, 1)], "law_id bigint, n bigint")
    told = ["id", "law_id", "cost", "n_fit", "nearest"]
    one = sorted(map(str, map_to_reference(links, laws, "id", "alias", counts).select(told).collect()))
    assert len(one) == len(names) * 2
    for bound in (8, 4, 1):
        assert one == sorted(map(str, map_to_reference(links, laws, "id", "alias", counts, bound).select(told).collect()))
