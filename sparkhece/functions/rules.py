"""Rule tables and word lists that results depend on."""

from __future__ import annotations

# Colloquial endings and their standard forms, in the order they are applied. A rule is
# (pattern of the whole word, replacement in Java's notation); word bounds are added where it is used.
_V = "[aeiouöüı]"
_C = "[bçdfghjklmnprsştvyz]"

FUTURE = [
    (rf"(\w*{_V})({_C})cak", "$1$2acak"),
    (rf"(\w*{_V})({_C})cam", "$1$2acağım"),
    (rf"(\w*{_V})({_C})can", "$1$2acaksın"),
    (rf"(\w*{_V})({_C})caz", "$1$2acağız"),
    (rf"(\w*{_V})({_C})caklar", "$1$2acaklar"),
    (rf"(\w*{_V})({_C})cek", "$1$2ecek"),
    (rf"(\w*{_V})({_C})cem", "$1$2eceğim"),
    (rf"(\w*{_V})({_C})cen", "$1$2eceksin"),
    (rf"(\w*{_V})({_C})cez", "$1$2eceğiz"),
    (rf"(\w*{_V})({_C})cekler", "$1$2ecekler"),
    (r"(\w+[aıou])cam", "$1yacağım"),
    (r"(\w+[aıou])can", "$1yacaksın"),
    (r"(\w+[aıou])cak", "$1yacak"),
    (r"(\w+[aıou])caz", "$1yacağız"),
    (r"(\w+[eöiü])cem", "$1yeceğim"),
    (r"(\w+[eöiü])cen", "$1yeceksin"),
    (r"(\w+[eöiü])cek", "$1yecek"),
    (r"(\w+[eöiü])cez", "$1yeceğiz"),
    (r"(\w+)acam", "$1acağım"),
    (r"(\w+)ıcam", "$1acağım"),
    (r"(\w+)icam", "$1eceğim"),
    (r"(\w+)ecem", "$1eceğim"),
    (r"(\w+)icem", "$1eceğim"),
    (r"(\w+)acan", "$1acaksın"),
    (r"(\w+)ıcan", "$1acaksın"),
    (r"(\w+)ecen", "$1eceksin"),
    (r"(\w+)icen", "$1eceksin"),
    (r"(\w+)acaz", "$1acağız"),
    (r"(\w+)ıcaz", "$1acağız"),
    (r"(\w+)ecez", "$1eceğiz"),
    (r"(\w+)icez", "$1eceğiz"),
    (r"(\w+)ıcak", "$1acak"),
    (r"(\w+)icek", "$1ecek"),
]
PRESENT = [
    (r"(\w+)iyom", "$1iyorum"),
    (r"(\w+)iom", "$1iyorum"),
    (r"(\w+)ıyom", "$1ıyorum"),
    (r"(\w+)ıom", "$1ıyorum"),
    (r"(\w+)uyom", "$1uyorum"),
    (r"(\w+)uom", "$1uyorum"),
    (r"(\w+)üyom", "$1üyorum"),
    (r"(\w+)üom", "$1üyorum"),
    (r"(\w+)iyon", "$1iyorsun"),
    (r"(\w+)iyosun", "$1iyorsun"),
    (r"(\w+)ıyon", "$1ıyorsun"),
    (r"(\w+)ıyosun", "$1ıyorsun"),
    (r"(\w+)uyon", "$1uyorsun"),
    (r"(\w+)uyosun", "$1uyorsun"),
    (r"(\w+)üyon", "$1üyorsun"),
    (r"(\w+)üyosun", "$1üyorsun"),
    (r"(\w+)iyo", "$1iyor"),
    (r"(\w+)ıyo", "$1ıyor"),
    (r"(\w+)uyo", "$1uyor"),
    (r"(\w+)üyo", "$1üyor"),
    (r"(\w+)iyoz", "$1iyoruz"),
    (r"(\w+)ıyoz", "$1ıyoruz"),
]
NEGATIVE = [
    (r"(\w+)mıycam", "$1mayacağım"),
    (r"(\w+)mayacam", "$1mayacağım"),
    (r"(\w+)miycem", "$1meyeceğim"),
    (r"(\w+)meyecem", "$1meyeceğim"),
    (r"(\w+)mıycak", "$1mayacak"),
    (r"(\w+)miycek", "$1meyecek"),
    (r"(\w+)mıycan", "$1mayacaksın"),
    (r"(\w+)miyecen", "$1meyeceksin"),
]
QUESTION = [
    (r"(\w+)iyonmu", "$1iyor musun"),
    (r"(\w+)ıyonmu", "$1ıyor musun"),
    (r"(\w+)uyonmu", "$1uyor musun"),
    (r"(\w+)üyonmu", "$1üyor musun"),
    (r"(\w+)iyomu", "$1iyor mu"),
    (r"(\w+)ıyomu", "$1ıyor mu"),
]
OTHER = [
    (r"(\w+[aıou])dı", "$1dır"),
    (r"(\w+[eiöü])di", "$1dir"),
    (r"(\w+[aıou])du", "$1dur"),
    (r"(\w+[eiöü])dü", "$1dür"),
]
ACCENT = {"negative": NEGATIVE, "future": FUTURE, "present": PRESENT, "question": QUESTION, "other": OTHER}
#: Endings that every word changed by a rule has before or after an earlier rule (a superset, for pre-filtering).
ACCENT_GUARD = r"c[ae][kmnz]|c[ae]kl[ae]r|[ıiuü]y?o|[aıou]d[ıu]|[eiöü]d[iü]"

# Whole-word corrections of text typed without diacritics.
CORRECTIONS = {
    "ben": "ben", "sen": "sen", "o": "o", "biz": "biz", "siz": "siz", "onlar": "onlar",
    "bu": "bu", "su": "şu", "bunlar": "bunlar", "sunlar": "şunlar",
    "bir": "bir", "iki": "iki", "uc": "üç", "dort": "dört", "bes": "beş", "alti": "altı",
    "yedi": "yedi", "sekiz": "sekiz", "dokuz": "dokuz", "on": "on",
    "cok": "çok", "cox": "çok", "az": "az", "hic": "hiç",
    "var": "var", "yok": "yok", "ve": "ve", "veya": "veya", "ile": "ile",
    "icin": "için", "gibi": "gibi", "kadar": "kadar", "gore": "göre",
    "sonra": "sonra", "once": "önce", "simdi": "şimdi", "suanda": "şuanda",
    "ne": "ne", "nasil": "nasıl", "neden": "neden", "nerede": "nerede", "kim": "kim",
    "hangi": "hangi", "kac": "kaç", "ne zaman": "ne zaman",
    "gundem": "gündem", "gun": "gün", "gece": "gece", "sabah": "sabah", "aksam": "akşam",
    "iyi": "iyi", "guzel": "güzel", "kotu": "kötü", "fena": "fena",
    "buyuk": "büyük", "kucuk": "küçük", "uzun": "uzun", "kisa": "kısa",
    "gitmek": "gitmek", "gelmek": "gelmek", "yapmak": "yapmak", "olmak": "olmak",
    "almak": "almak", "vermek": "vermek", "gormek": "görmek", "bilmek": "bilmek",
    "istiyorum": "istiyorum", "geliyorum": "geliyorum", "gidiyorum": "gidiyorum",
    "yapiyorum": "yapıyorum", "biliyorum": "biliyorum",
    "istanbul": "İstanbul", "ankara": "Ankara", "izmir": "İzmir", "bursa": "Bursa",
    "turkiye": "Türkiye", "turk": "Türk",
    "lutfen": "lütfen", "ltfn": "lütfen", "tsk": "teşekkür", "tskler": "teşekkürler",
    "msj": "mesaj", "tmm": "tamam", "ok": "tamam",
    "nbr": "ne haber", "naber": "ne haber", "nslsn": "nasılsın",
    "sey": "şey", "seyler": "şeyler", "seyi": "şeyi", "sunu": "şunu",
    "sehir": "şehir", "seker": "şeker", "sarki": "şarkı",
    "calisma": "çalışma", "calisiyorum": "çalışıyorum", "calismak": "çalışmak",
    "cocuk": "çocuk", "cicek": "çiçek",
    "aglamak": "ağlamak", "diger": "diğer", "dogru": "doğru",
    "ogrenci": "öğrenci", "ogrenmek": "öğrenmek", "ogretmen": "öğretmen",
    "ulke": "ülke", "universite": "üniversite", "urun": "ürün",
    "ornek": "örnek", "onemli": "önemli", "ozel": "özel",
    "isik": "ışık", "kisin": "kışın", "kis": "kış",
}

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    "dr", "prof", "doç", "yrd", "yar", "mr", "mrs", "ms", "ltd", "şti", "inc", "corp", "no", "tel", "faks", "gsm",
    "vs", "vb", "vd", "kr", "blv", "cad", "sok", "mah", "ör", "örn", "dz", "kd", "tğm", "bnb", "yb", "alb", "korg",
    "bkz", "sf", "sy", "s", "apt", "daire", "kat", "st", "ave", "rd",
)

# Patterns of entities that a token may be.
URL = r"https?://[^\s]+|www\.[^\s]+|[a-zA-Z0-9-]+\.[a-zA-Z]{2,}[^\s]*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
HASHTAG = r"#\w+"
MENTION = r"@\w+"

# Letters.
VOWELS = "aeıioöuü"
TURKISH = "şçğüöıŞÇĞÜÖİ"
FOLD_FROM, FOLD_TO = "şçğüöıî", "scguoii"
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"
DIACRITIC_PAIRS = {"c": "ç", "g": "ğ", "i": "ı", "o": "ö", "s": "ş", "u": "ü"}
PUNCTUATION = ".,!?;:()[]{}\"'-/"
