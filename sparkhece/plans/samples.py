"""Small inline tables for the queries whose inputs the corpus does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLLOQUIAL = [
    "geliyom", "gidiyon", "napıyosun", "gelcem", "yapcak", "okucam", "başlıcaz", "gitmiycem", "almıycan", "biliyonmu",
    "yapıyomu", "gidicez", "gelicekler", "bakcaz", "verecen", "yapacak", "gelecek", "başladı", "güldü", "duydu", "evde", "masa",
    "istiyoz", "koşuyo", "görüyom", "uyuyon", "söylicem", "bekliyom", "gelmiycek", "soruyonmu",
]
SUFFIXES = [
    ("lar", "INFLECTIONAL"), ("ler", "INFLECTIONAL"), ("dan", "INFLECTIONAL"), ("den", "INFLECTIONAL"), ("da", "INFLECTIONAL"), ("de", "INFLECTIONAL"),
    ("ın", "INFLECTIONAL"), ("in", "INFLECTIONAL"), ("ımız", "INFLECTIONAL"), ("imiz", "INFLECTIONAL"), ("ları", "INFLECTIONAL"), ("leri", "INFLECTIONAL"),
    ("nın", "INFLECTIONAL"), ("nin", "INFLECTIONAL"), ("ım", "INFLECTIONAL"), ("im", "INFLECTIONAL"), ("la", "INFLECTIONAL"), ("le", "INFLECTIONAL"),
    ("er", "INFLECTIONAL"), ("en", "INFLECTIONAL"), ("an", "INFLECTIONAL"), ("es", "INFLECTIONAL"), ("e", "INFLECTIONAL"), ("a", "INFLECTIONAL"),
    ("lik", "DERIVATIONAL"), ("lık", "DERIVATIONAL"), ("ci", "DERIVATIONAL"), ("cı", "DERIVATIONAL"), ("siz", "DERIVATIONAL"), ("sız", "DERIVATIONAL"),
    ("ment", "DERIVATIONAL"), ("ion", "DERIVATIONAL"), ("mek", "DERIVATIONAL"), ("mak", "DERIVATIONAL"), ("ki", "FUNCTIONAL"), ("mi", "FUNCTIONAL"), ("mı", "FUNCTIONAL"),
]
ABBREV = [("th", "theheth"), ("er", "er er"), ("dr", "doktor"), ("der", "der die"), ("of", "out of")]
MISSPELLED = ["cok", "kitpa", "okll", "gidyorum", "masaa", "ağaç", "evv", "guzel", "arkadas", "kapi"]
# Misspelled words and what a spelling corrector is to make of them, in their order.
SPELLING = [
    ("cok", "çok"), ("cocuk", "çocuk"), ("agac", "ağaç"), ("cicek", "çiçek"), ("kac", "kaç"), ("seker", "şeker"), ("masa", "masa"), ("basla", "başla"),
    ("isik", "ışık"), ("sarki", "şarkı"), ("agir", "ağır"), ("yagmur", "yağmur"), ("dogru", "doğru"), ("bagir", "bağır"), ("soguk", "soğuk"),
    ("guzel", "güzel"), ("goz", "göz"), ("sonra", "sonra"), ("gosterge", "gösterge"), ("koy", "köy"), ("uzgun", "üzgün"), ("urun", "ürün"),
    ("yuksel", "yüksel"), ("gul", "gül"), ("mutlu", "mutlu"), ("sinif", "sınıf"), ("isim", "isim"), ("kitap", "kitap"), ("kirmizi", "kırmızı"),
    ("yikama", "yıkama"), ("tesekkur", "teşekkür"), ("ogretmen", "öğretmen"), ("ogrenci", "öğrenci"), ("gonul", "gönül"), ("guneş", "güneş"),
    ("okl", "okul"), ("ktap", "kitap"), ("dfter", "defter"), ("klm", "kalem"), ("mrhaba", "merhaba"), ("okull", "okul"), ("gitt", "git"),
    ("kaleem", "kalem"), ("evvde", "evde"), ("yazzma", "yazma"), ("gti", "git"), ("evd", "evde"), ("klitap", "kitap"), ("kaelm", "kalem"),
    ("yerş", "yer"), ("peder", "defter"), ("kelem", "kalem"), ("yaz", "yaz"), ("akul", "okul"), ("gat", "git"), ("ktp", "kitap"), ("klm", "kalem"),
    ("dftr", "defter"), ("mrh", "merhaba"), ("nslsn", "nasılsın"), ("okldan", "okuldan"), ("merhba", "merhaba"), ("nasilsin", "nasılsın"),
    ("bugun", "bugün"), ("eglencli", "eğlenceli"), ("sevyorum", "seviyorum"), ("gidyorum", "gidiyorum"), ("geliyrom", "geliyorum"),
    ("yapiorm", "yapıyorum"), ("biliyrom", "biliyorum"), ("iyii", "iyi"), ("kotuu", "kötü"), ("twtter", "twitter"), ("aksam", "akşam"),
    ("sabah", "sabah"), ("tesekkurr", "teşekkür"), ("okulda", "okulda"), ("sinifta", "sınıfta"), ("deftre", "defter"), ("ogrencii", "öğrenci"),
    ("ogretmen", "öğretmen"),
]
LEXICON = [("çok", 40), ("kitap", 20), ("okul", 20), ("gidiyorum", 10), ("masa", 15), ("ağaç", 5), ("ev", 60), ("güzel", 30), ("arkadaş", 12), ("kapı", 9), ("kapa", 2), ("geliyorum", 10)]
ERROR_PAIRS = [("cok", "çok"), ("gzl", "güzel"), ("kitpa", "kitap"), ("evv", "ev"), ("ok", "çok"), ("guzel", "güzel"), ("", "a"), ("b", "")]
ACCURACY = [("Geliyom", "geliyorum"), ("gidicez", "gidiyeceğiz"), ("TÜRKÇE", "türkçe"), ("cok", "çok"), ("ktp", "kitap"), ("ahmet'ten", "Ahmet'ten"), ("guzel", "güzel"), ("evv", "ev"), ("masa", "masa"), ("okulll", "okul")]
MORPH = (
    "Ali\n\tAli+Noun+[Prop]+A3sg\n\nkitabı\n\tkitap+Noun+A3sg+Acc\n\tkitap+Noun+A3sg+P3sg\n" + "-" * 50 + "\nokudu\n\toku+Verb+Past\nAli\n\tali+Adj\n\tAli+Noun+[Prop]\n"
)
CASES = ["ahmet'ten", "ığdır'dan", "TÜRKÇE", "dr.", "Dr.", "İSTANBUL", "iyi", "I", "i", "", "Ankara'ya", "ABC.", "aBc", "123", "Işık", "ŞEKER'den"]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def values(rows: list, names: str) -> str:
    """The same rows as a SQL table expression."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(quote(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"
