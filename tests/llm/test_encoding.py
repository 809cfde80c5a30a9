import pytest

from docketry.llm.encoding import implausible, mend, restore, search

TEXTS = ["Décision sur l’appel de Štěpán – « sans garantie »", "Règlement no 920 sur la remise en état des marchés nocturnes", "Le conseil a été reçu où l’hiver a été rigoureux"]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251"])
def test_round_trip(wrong):
    for t in TEXTS[1:]:
        try:
            bad = t.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        assert mend(bad) == (True, t, True), (wrong, bad)


def test_twice_and_gbk():
    t = "Décret sur l’accès"
    twice = t.encode().decode("cp1252").encode().decode("cp1252")
    assert mend(twice) == (True, t, True)
    assert mend("D茅cret sur l鈥檃cc猫s") == (True, t, True)
    zh = "法院认为合同有效"
    assert mend(zh.encode("gbk").decode("latin-1"))[:2] == (True, zh)
    assert mend(zh.encode().decode("latin-1"))[:2] == (True, zh)


def test_entities_of_damaged_text(spark):
    bad = {1: "Montr&Atilde;&copy;al", 2: "l&acirc;&euro;&trade;appel", 3: "caf&#195;&#169;", 4: "&middot;&uml;&Ocirc;&ordm;&Egrave;&Iuml;&Icirc;&ordf;"}
    good = {5: "Caf&eacute; &amp; th&eacute;", 6: "AT&T; R&D", 7: "&laquo;&nbsp;oui&nbsp;&raquo;", 8: "l&#8217;&eacute;t&eacute;", 9: "&copy;&nbsp;2020", 10: "&lt;p&gt;", 11: "na&iuml;ve &Eacute;cole", 12: "&pound;&nbsp;20", 13: "x&reg;&nbsp;i"}
    df = spark.createDataFrame([*bad.items(), *good.items()], "id int, t string")
    want = {1: "Montréal", 2: "l’appel", 3: "café", 4: "法院认为"}
    assert {r["id"]: r["restored"] for r in restore(df, ["id"], "t").collect()} == want


def test_passage_in_good_text():
    good = "Été – la décision.\n"
    assert mend(good + TEXTS[1].encode().decode("cp1252")) == (True, good + TEXTS[1], True)


def test_genuine_text_is_left_alone():
    for t in [*TEXTS, "", "plain", "Café &eacute; &amp; &rsquo;", "SÃO BRÁS – GOURLIÃSEN", "Café Ô’Lac", "Œuvre Â – £ 67", "√(a² + b²) § 12 ¶ 3 ©", "Δσκλσ v. Haendaen", "Дубровин, договор", "├── A\n└── B", "按“现状”且不可追索。", "Đặng Văn", "congé »", "Ñandú’s"]:
        assert mend(t) == (False, t, True), t


SCRIPTS = [
    "안녕하세요 저는 학생입니다", "대한민국의 주권은 국민에게 있고, 모든 권력은 국민으로부터 나온다.", "개인정보보호법시행령일부개정령안", "법률", "民法(민법)과 刑法(형법)", "大韓民國憲法",
    "とうきょう カタカナ", "日本国民は、正当に選挙された国会における代表者を通じて行動し、", "コンピュータ・プログラムの著作物", "ﾃｽﾄ ｶﾀｶﾅ", "のア",
    "รัฐธรรมนูญแห่งราชอาณาจักรไทย", "يولد جميع الناس أحرارا متساوين", "כל בני אדם נולדו בני חורין", "सभी मनुष्यों को गौरव और अधिकारों", "மனிதப் பிறிவியினர்",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng", "Nguyễn Thị Hường", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι", "Все люди рождаются свободными", "Еелесаеи’s Estate",
    "人人生而自由,在尊嚴和權利上一律平等。臺灣高等法院裁判書", "Zażółć gęślą jaźń", "Příliš žluťoučký kůň", "ŞİRKET İÇİN", "ყველა ადამიანი", "Բոլոր մարդիկ", "Great 👍🏽 work", "Smith v. 김철수", "東京 Tokyo 판결",
]


@pytest.mark.parametrize("text", SCRIPTS)
def test_other_scripts_are_left_alone(text):
    for t in (text, text.replace(" ", ""), f"({text})", f"The case {text} of 2020"):
        assert mend(t) == (False, t, True), t


@pytest.mark.parametrize("text", [t for t in SCRIPTS if not t.isascii() and "Smith" not in t])
def test_other_scripts_are_restored(text):
    bad = text.encode().decode("latin-1")
    damaged, new, _ = mend(bad)
    assert damaged and sum(a == b for a, b in zip(new, text)) >= 0.9 * len(text), new


def test_chinese_read_as_korean():
    for t in ("最高人民法院", "原告请求被告支付货款及利息"):
        assert mend(t.encode("gbk").decode("cp949"))[:2] == (True, t)


def test_lost_characters_count():
    assert mend("Lt�e") == (True, "Lt�e", False)
    assert mend("l\x92appel") == (True, "l’appel", True)


def test_search_is_cheapest_first():
    text, cost, path = search("Ã©", "t", " ")
    assert text == "é" and path == (("sloppy", "utf-8"),) and cost < implausible("Ã©", "t", " ")


def test_operator_edges(spark):
    bad = TEXTS[1].encode().decode("cp1252")
    rows = [(1, None), (2, ""), (3, bad), (3, bad), (4, TEXTS[0]), (5, "x" * 300_000 + bad), (6, "été " * 60_000)]
    df = spark.createDataFrame(rows, "id bigint, v string").selectExpr("*", "'a' as _text", "1 as restored")
    got = sorted((r["id"], r["restored"][-len(TEXTS[1]) :], r["complete"]) for r in restore(df, ["id"], "v").collect())
    assert got == [(3, TEXTS[1], True), (3, TEXTS[1], True), (5, TEXTS[1], True)]
    assert restore(df.limit(0), ["id"], "v").count() == 0
