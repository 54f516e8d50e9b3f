import pytest

from sparkhece.functions import case, rules, text


def test_case(column):
    given = ["ahmet'ten", "ığdır'dan", "TÜRKÇE", "dr.", "Dr.", "istanbul", "Ankara'ya", "", None]
    assert column(case.case_transform, given) == ["Ahmet'ten", "Iğdır'dan", "türkçe", "Dr.", "dr.", "istanbul", "Ankara'ya", "", None]
    assert column(case.tr_lower, ["IŞIK", "İZMİR", None]) == ["ışık", "izmir", None]
    assert column(case.tr_upper, ["ışık", "izmir", "straße"]) == ["IŞIK", "İZMİR", "STRASSE"]
    assert column(case.tr_capitalize, ["istanbul", "", "ILIK"]) == ["İstanbul", "", "Ilık"]
    assert column(case.is_proper, ["Ali", "ALİ", "A", "", "ali"]) == [True, False, True, False, False]


def test_match_case_is_not_turkish(spark):
    row = spark.sql("SELECT 'İstanbul' AS c, 'istanbul' AS low, 'ISTANBUL' AS up, 'Istanbul' AS first")
    got = row.select(case.match_case("c", "low"), case.match_case("c", "up"), case.match_case("c", "first")).first()
    assert got[0] == "i̇stanbul" and got[1] == "İSTANBUL" and got[2] == "İstanbul"


@pytest.mark.parametrize(
    ("word", "standard"),
    [
        ("geliyom", "geliyorum"), ("gitmiycem", "gitmeyeceğim"), ("yapiyonmu", "yapiyor musun"), ("yapacak", "yapayacak"), ("gidicem", "gidiyeceğim"),
        ("gelecek", "geleyecek"), ("başladı", "başladır"), ("masa", "masa"), ("", ""), (None, None), ("dün geliyom ben", "dün geliyorum ben"),
    ],
)
def test_accent(column, word, standard):
    assert column(text.accent, [word]) == [standard]


def test_accent_groups_and_guard(spark, column):
    assert column(lambda s: text.accent(s, ["present", "unknown"]), ["geliyom gelcem"]) == ["geliyorum gelcem"]
    assert sum(map(len, rules.ACCENT.values())) == 73
    assert len(rules.CORRECTIONS) == 114


def test_corpus_tokens(column):
    given = ["IŞIK abc123 résumé türk'ün", "", None, "x" * 50_000]
    assert column(text.corpus_tokens, given) == [["ışık", "türk", "ün"], [], [], ["x" * 50_000]]


def test_words_and_gaps_join_to_the_text(column):
    for t in ["a, b!", " x ", "é-ü", ""]:
        assert "".join(column(text.words_and_gaps, [t])[0]) == t


def test_vowel_pattern(spark):
    rows = spark.sql("SELECT * FROM VALUES ('ktp','kitap'), ('ktp','kutup'), ('okl','okul'), ('k.p','k.p'), ('k.p','kap'), ('a','a'), ('ktp','kaitap'), ('','') AS t(w, c)")
    got = [r[0] for r in rows.withColumn("p", text.vowel_pattern("w")).selectExpr("c rlike p").collect()]
    assert got == [True, True, False, True, False, True, False, False]
