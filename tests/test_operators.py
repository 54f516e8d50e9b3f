import pytest
from pyspark.sql import functions as F

from sparkhece.functions import text
from sparkhece.operators import evaluate, mltok, normalize, sentences, stem, stopwords, tokenize
from sparkhece.plans import samples, services
from sparkhece.register import register
from sparkhece.sources import lexicons


def test_rule_tokens():
    t = tokenize.tokens_of
    assert t("Fiyat 123.45 TL olarak belirlendi.") == ["Fiyat", "123.45", "TL", "olarak", "belirlendi", "."]
    assert t("info@example.com") == ["info@___URL_0___"]
    assert t("#NLP.") == ["#NLP."]
    assert t("(Ankara'ya)...") == ["(", "Ankara'ya", ")", ".", ".", "."]
    assert t("Gitti.Ali geldi") == ["Gitti.Ali", "geldi"]
    assert t("") == [] and t(None) == []
    assert t("hem de ne", ["hem de"]) == ["hem_de", "ne"]
    assert t("hemde", ["hem de"]) == ["hemde"]


def test_clean_equals_compat_without_entities(column):
    given = ["Ali, (geldi)!", "a_b -x- 'y'", "…", "", None, "çok iyi"]
    clean = column(lambda s: tokenize.rule_tokens(s, mode="clean"), given)
    assert clean == [tokenize.tokens_of(g) for g in given]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Dr. Ahmet Yılmaz geldi. Prof. Ayşe Demir de oradaydı.", 2), ("Fiyat 3.14 TL idi. Yeni fiyat 5.99 TL oldu.", 2),
        ("Ne yapıyorsun?! Dur bir dakika!!", 2), ('Ali "Bugün hava çok güzel." dedi. Ayşe de "Evet, haklısın." diye cevap verdi.', 1),
        ("Ankara'ya gitti. Sonra döndü.", 1), ("Fiyat 3,14. Yeni fiyat.", 2), ("Fiyat 3,14. yeni fiyat.", 1), ("", 0), (None, 0), ("«Gel.» Gitti.", 2),
    ],
)
def test_sentences(text, n):
    assert len(sentences.split_text(text)) == n


def test_ellipsis_and_clean_mode():
    assert sentences.split_text("Bitti...! Evet") == ["Bitti...", "!", "Evet"]
    assert sentences.split_text("Ankara'ya gitti. Sonra döndü.", quotes=False) == ["Ankara'ya gitti.", "Sonra döndü."]


def test_naive_bayes_round(spark):
    rows = [(1, i, s) for i, s in enumerate(["Ali geldi.", "Veli 3.5 lira verdi.", "Kim bu?", "Dr. Can burada."])]
    lines = spark.createDataFrame(rows, "g int, line_no int, sentence string")
    features, classes = sentences.nb_train(sentences.nb_examples(lines, group="g"))
    assert {r["class"]: r["n"] for r in classes.collect()} == {"boundary": 10, "non_boundary": 2}
    model = sentences.nb_weights(features, classes)
    docs = spark.createDataFrame([(1, "Ali geldi.Veli 2.5 verdi."), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.sentence) for r in sentences.nb_split(docs, "text", ["doc_id"], model).orderBy("doc_id", "sent_no").collect()]
    assert got == [(1, "Ali geldi."), (1, "Veli 2.5 verdi.")]
    with pytest.raises(ValueError):
        sentences.nb_weights(features.limit(0), classes)


GOLD = {
    "kitaplarımızdan": ("kitap", ["dan", "ımız", "lar"], 123), "evlerimizde": ("ev", ["de", "imiz", "ler"], 58),
    "çocuklarının": ("çocuk", ["nın", "ları"], 122), "kitabın": ("kitap", ["ın"], 121), "arkadaşlarımla": ("arkadaş", ["la", "ım", "lar"], 113),
}


def test_stemmer(spark):
    s = stem.Stemmer(dict(samples.SUFFIXES), frozenset("kitap ev çocuk öğrenci gel yap güzel arkadaş masa araba okul".split()))
    for word, (root, removed, tenths) in GOLD.items():
        d = s.details(word)
        assert (d["stem"], d["removed_suffixes"], round(d["score"] * 10)) == (root, removed, tenths)
    assert s.stem("") == "" and s.stem(None) is None and s.stem("qq") == "qq"
    rows = spark.createDataFrame([("kitabın",), (None,)], "w string").select(stem.details_column("w", s).alias("d")).collect()
    assert rows[0].d.stem == "kitap" and rows[0].d.suffix_categories == ["INFLECTIONAL"]
    assert stem.category_statistics(samples.frame(spark, samples.SUFFIXES, "suffix string, category string")).count() == 3


def test_stemmer_variants():
    assert stem.Stemmer.variants("kitab", "ı") == ["kitab", "kitap"]
    assert stem.Stemmer.variants("hiss", "i") == ["hiss", "hisıs", "hisis", "hisus", "hisüs", "his"]
    assert stem.Stemmer.variants("suy", "u") == ["suy", "su"]
    assert not stem.Stemmer.harmony("kitap", "ler") and stem.Stemmer.harmony("brk", "ler")


def test_diacritics_and_vowels(spark):
    lex = spark.createDataFrame([("kitap",), ("kutup",), ("okul",), ("şeker",), ("agac",), ("ağaç",), ("kış",)], "word string")
    words = spark.createDataFrame([("cok",), ("istanbul",), ("seker",), ("agac",), ("SEKER",), ("ağ",), ("x",), ("",)], "token string")
    got = {r.token: r.restored for r in normalize.restore_diacritics(words, lex).collect()}
    assert got == {"cok": "çok", "istanbul": "i̇stanbul", "seker": "şeker", "agac": "agac", "SEKER": "ŞEKER", "ağ": "ağ", "x": "x", "": ""}
    words = spark.createDataFrame([("ktp",), ("okl",), ("kitap",), ("zzz",)], "token string")
    got = {r.token: r.restored for r in normalize.restore_vowels(words, lex).collect()}
    assert got == {"ktp": "kitap", "okl": "okl", "kitap": "kitap", "zzz": "zzz"}


def test_variants_and_corrections(spark, column):
    assert normalize.diacritic_variants("si") == ["si", "sı", "sî", "şi", "şı", "şî"] and normalize.diacritic_variants("Ub") == ["Ub", "Üb"]
    assert len(normalize.diacritic_variants("s" * 12)) == 200 and normalize.diacritic_variants("") == [""]
    words = spark.createDataFrame([("Cok",), ("x",), (None,)], "token string")
    assert sorted((r.token or "", r.corrected or "") for r in normalize.correct_by_list(words).collect()) == [("", ""), ("Cok", "Çok"), ("x", "x")]
    assert column(text.segments, ["aekitap", "brr", "", None]) == [["ae", "ki", "ta", "p"], ["b", "r", "r"], [], []]


def test_spelling():
    assert dict(reversed(list(normalize.one_edit("cok"))))["çok"] == 0.3
    prob = {"oğl": 0.5, "kal": 0.5}
    assert normalize.correct("gol", prob) == "oğl"
    assert normalize.correct("kal", prob) == "kal" and normalize.correct("", prob) == "" and normalize.correct(None, prob) is None
    assert normalize.correct("kitpa", {"kitap": 0.1, "kita": 0.01}) == "kitap"
    assert normalize.correct("xyzw", prob) == "xyzw"


def test_spelling_frame(spark):
    out = normalize.correct_spelling(samples.frame(spark, samples.MISSPELLED, "token string"), samples.frame(spark, samples.LEXICON, "word string, freq long"))
    got = {r.token: r.corrected for r in out.collect()}
    assert got["cok"] == "çok" and got["kitpa"] == "kitap" and got["ağaç"] == "ağaç" and got["arkadas"] == "arkadaş" and got["kapi"] == "kapı"


def test_error_model(spark):
    assert normalize.edit_script("cok", "çok") == ["sub:c:ç"] and normalize.edit_script("", "a") == ["ins:a"] and normalize.edit_script("b", "") == ["del:b"]


def test_pipeline_and_services(spark):
    lex = samples.frame(spark, samples.LEXICON, "word string, freq long")
    docs = spark.createDataFrame([(1, "Geliyom cok guzel 12 !"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.results for r in services.normalize(docs, lex).collect()}
    assert got[1] == ["Geliyom → geliyorum", "cok → çok", "guzel → güzel", "12", "!"] and got[2] == [] and got[3] == []
    abbr = spark.createDataFrame([("tc", "Türkiye Cumhuriyeti")], "abbr string, full_form string")
    assert normalize.expand_text(docs.limit(1).withColumn("text", F.lit("(TC) tc'de tc1")), abbr).first().expanded == "(Türkiye Cumhuriyeti) Türkiye Cumhuriyeti'de tc1"


def test_stopwords(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, ""), (4, None)], "doc_id int, text string")
    f = {r.word: r for r in stopwords.frequencies(docs).collect()}
    assert f["a"].df == 2 and abs(f["a"].avg_tf - (2 / 3 + 1 / 2) / 2) < 1e-12 and abs(f["a"].idf - 0.6931471805599453) < 1e-12
    per = {(r.doc_id, r.word): r.tf for r in stopwords.terms(docs).collect()}
    assert abs(sum(v for (d, _), v in per.items() if d == 1) - 1) < 1e-12
    kept = docs.select(stopwords.remove_stopwords("text", ["a"]).alias("x")).collect()
    assert [r.x for r in kept[:3]] == ["b", "c", ""]
    assert docs.select(stopwords.remove_stopwords("text", []).alias("x")).first().x == "a b a"
    assert stopwords.word_array(stopwords.combined(stopwords.frequencies(docs), 1.0, 0.4)) == ["a"]


def test_evaluation(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a", "b"]), ([], ["x"]), ([], [])], "p array<string>, g array<string>")
    rows = [r.s for r in d.select(evaluate.token_scores(F.col("p"), F.col("g")).alias("s")).collect()]
    assert abs(rows[0].precision - 2 / 3) < 1e-12 and rows[0].recall == 1.0 and not rows[0].exact and rows[1].f1 == 0.0 and rows[2].exact
    pairs = spark.createDataFrame([(" a", "a"), (None, "b"), ("c", "d")], "output string, expected string")
    a = evaluate.accuracy(pairs).first()
    assert (a.total, a.passed, a.errors, a.ok) == (3, 1, 1, False)
    assert [r[0] for r in pairs.select(evaluate.status(F.col("output"), F.col("expected"))).collect()] == ["PASS", "ERROR", "FAIL"]


def test_ml_tokenizer(spark):
    d = spark.createDataFrame([(1, "Ali geldi."), (2, ""), (3, None)], "doc_id int, text string").withColumn("tokens", tokenize.rule_tokens("text"))
    ends = {r.doc_id: r.e for r in d.select("doc_id", mltok.token_ends("text", "tokens").alias("e")).collect()}
    assert ends[1] == [2, 8, 9]
    rows = mltok.labelled(d)
    assert rows.count() == 10 and rows.where("label = 1").count() == 3 and len(mltok.TEXTS) + len(mltok.FLAGS) == 25
    model = mltok.train(rows, buckets=1 << 10, iterations=50)
    got = {r.doc_id: r.tokens for r in mltok.tokenize(d.select("doc_id", "text"), model).collect()}
    assert got[1] == ["Ali", "geldi", "."] and got[2] == []


def test_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Ev\n ev \n\nMasa\n", encoding="utf-8")
    (tmp_path / "s.csv").write_text("word,category\n-lar,Inflectional\n-a-,odd\nki,Functional\n-lar-,Inflectional\n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("tc: Bir\nno colon\nTC: İki: üç\n", encoding="utf-8")
    (tmp_path / "t.csv").write_text("erroneous,correct\ncok, çok\n", encoding="utf-8")
    p = str(tmp_path)
    assert {r.word for r in lexicons.lexicon(spark, f"{p}/w.txt").collect()} == {"ev", "masa"}
    assert lexicons.lexicon(spark, f"{p}/none.txt", True).count() == 0 and lexicons.lexicon_or_corrections(spark, f"{p}/none.txt").count() > 50
    assert [tuple(r) for r in lexicons.suffixes(spark, f"{p}/s.csv").collect()] == [("lar", "INFLECTIONAL"), ("ki", "FUNCTIONAL"), ("a", "INFLECTIONAL")]
    assert [tuple(r) for r in lexicons.abbreviations(spark, f"{p}/a.txt").collect()] == [("tc", "İki: üç")]
    assert tuple(lexicons.test_pairs(spark, f"{p}/t.csv").first()) == (1, "cok", "çok")
    lexicons.write_words(lexicons.lexicon(spark, f"{p}/w.txt"), f"{p}/out")
    assert [r.value for r in spark.read.text(f"{p}/out").collect()] == ["ev", "masa"]
    line = spark.createDataFrame([("Ali geldi., ['Ali', \"gel'di\", '.']",)], "value string")
    assert tuple(lexicons.annotated(line).first()) == ("Ali geldi.", ["Ali", "gel'di", "."])
    lexicons.tokenize_file(spark, f"{p}/w.txt", f"{p}/tok", lambda c: tokenize.rule_tokens(c))
    assert sorted(r.value for r in spark.read.text(f"{p}/tok").collect()) == ["Ev", "Masa", "ev"]


def test_register(spark):
    register(spark, stem.Stemmer({"lar": "INFLECTIONAL"}, frozenset(["kitap"])))
    got = spark.sql("SELECT tr_lower('IŞIK') a, tr_upper('ilk') b, tr_capitalize('istanbul') c, tr_tokens('A b1 c') d, tr_stem('kitaplar') e, tr_tokens_rule('x.') f").first()
    assert tuple(got) == ("ışık", "İLK", "İstanbul", ["a", "c"], "kitap", ["x", "."])
    assert [r.sentence for r in spark.sql("SELECT * FROM tr_sentences('Ali gitti. Veli kaldı.')").collect()] == ["Ali gitti.", "Veli kaldı."]


def test_repeated_and_null_keys_keep_texts_apart(spark):
    """Results depend on the text alone; rows are neither merged nor lost."""
    from sparkhece.functions.text import spaced_tokens
    from sparkhece.plans import services

    docs = spark.createDataFrame([(1, "dr bir"), (1, "iki dr"), (1, "iki dr"), (None, "dr uc"), (None, None), (2, "")], "doc_id long, text string")
    abbrev = spark.createDataFrame([("dr", "doktor")], "abbr string, full_form string")
    lex = spark.createDataFrame([("üç",), ("doktor",)], "word string")
    got = sorted((r.doc_id or 0, r.text, r.expanded) for r in normalize.expand_text(docs, abbrev).collect() if r.text is not None)
    assert got == [(0, "dr uc", "doktor uc"), (1, "dr bir", "doktor bir"), (1, "iki dr", "iki doktor"), (1, "iki dr", "iki doktor"), (2, "", "")]
    assert [r.expanded for r in normalize.expand_text(docs, abbrev).where("text IS NULL").collect()] == [None]
    off = ("spelling", "vowels")
    out = normalize.normalize_sequences(docs, spaced_tokens("text"), lex, abbrev, disabled=off).collect()
    assert sorted(" ".join(r.normalized) for r in out) == sorted(["doktor bir", "iki doktor", "iki doktor", "doktor üç", "", ""])
    assert sorted(r.normalized for r in normalize.normalize_text(docs, lex, abbrev, disabled=off).collect()) == sorted(["doktor bir", "iki doktor", "iki doktor", "doktor üç", "", ""])
    served = services.normalize(docs, lex, abbrev, disabled=off).collect()
    assert sorted(len(r.results) for r in served) == [0, 0, 2, 2, 2, 2]


def test_boundary_scores_with_repeated_and_null_keys(spark):
    lines = spark.createDataFrame([(1, 1, "Bir iki. "), (1, 2, "Üç dört!"), (1, 3, "Beş altı.")], "d int, line_no int, sentence string")
    model = sentences.nb_weights(*sentences.nb_train(sentences.nb_examples(lines, group="d")))
    docs = spark.createDataFrame([(1, "Bir iki. Üç"), (1, "Dört beş! Altı"), (None, "Bir iki. Üç"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.sent_no, r.sentence) for r in sentences.nb_split(docs, "text", ["doc_id"], model).collect())
    assert got == [(0, 0, "Bir iki."), (0, 1, "Üç"), (1, 0, "Bir iki."), (1, 0, "Dört beş!"), (1, 1, "Altı"), (1, 1, "Üç")]


def test_attempts_that_fail_are_error_rows(spark):
    from sparkhece.operators import evaluate

    rows = spark.createDataFrame([("4", "25"), ("x", "0"), ("2", "50")], "v string, expected string")
    done = rows.withColumn("out", evaluate.attempt(lambda v: str(100 // int(v)), "v"))
    got = {r.v: r.s for r in done.select("v", evaluate.status(done.out, done.expected).alias("s")).collect()}
    assert got == {"4": "PASS", "x": "ERROR", "2": "PASS"}


def test_long_text_with_many_marks_splits_in_linear_time():
    import time

    began = time.perf_counter()
    out = sentences.split_text("Bir! " * 40_000 + '" ' * 1000, False)
    assert len(out) == 40_001 and time.perf_counter() - began < 20


def test_neighbours_of_a_whole_table(spark):
    rows = [(i, f"Cümle {i}." if i % 3 else f"cümle {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "line_no int, sentence string").repartition(7)
    got = sorted((r.ex, r["class"], r._t, r._i) for r in sentences.nb_examples(df).collect())
    one = sorted((r.ex, r["class"], r._t, r._i) for r in sentences.nb_examples(df.withColumn("g", F.lit(1)), group="g").collect())
    assert got == one and sum("." in t[:-1] for _, _, t, _ in got) == 66 - (49 % 3 > 0) * 2
