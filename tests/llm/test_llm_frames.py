"""The training-data operators on small frames with nulls, repeats, clashing names and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkhece.llm import common, decontam, html_wrapper, langid, media_ogg, mixing, paragraphs, quality, simhash, suffix_dedup, toxicity
from sparkhece.llm.common import components

CLASH = "key string, fp string, h string, w string, t string, a string, b string"
LONG = "çok uzun bir metin " * 8000


def frame(spark, texts, first=0):
    rows = [(None if i == 1 else i + first, t, *["clash"] * 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


EDGES = [None, "", "", "kısa", "aynı metin burada", "aynı metin burada", LONG]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_frame(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    texts = EDGES + [" ".join(base)]
    for _ in range(25):
        other = list(base)
        other[rng.randrange(len(base))] = "x"
        texts.append(" ".join(other))
    texts += [" ".join(f"q{rng.randrange(900)}" for _ in range(50)) for _ in range(20)]
    df = frame(spark, texts)
    rows = df.collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r.doc_id)
    want = sorted((str(r.doc_id), fps[i], least[find(i)]) for i, r in enumerate(rows))
    for limit in (48, 1):  # by pairs, and by the second level alone
        got = simhash.near_duplicates(df, pair_limit=limit).collect()
        assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert len(set(least.values())) < len(rows) - 20
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_suffix_dedup_frame(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, whole = text(260), text(700)
    texts = EDGES + [text(300) + line + text(100), line + text(50), text(150) + line, whole, whole, text(50) + whole[100:500] + text(90), text(199), "é" * 300]
    df = frame(spark, texts)
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        want.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    for hot in (50_000, 1):
        got = suffix_dedup.dedup_substrings(df, hot=hot).collect()
        assert sorted((r.dedup.n_bytes, r.dedup.n_removed, len(r.dedup.spans), r.dedup.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_suffix_dedup_clashing_names_and_catalog(spark):
    names = "spans n_removed key _key tid kept_sha256 dedup t a b h w _c0 _c1 _cut".split()
    df = spark.createDataFrame([(1, "x" * 150 + LONG[:400], *names), (2, LONG[:400], *names), (2, LONG[:400], *names)], ["doc_id", "text", *names])
    got = suffix_dedup.dedup_substrings(df).orderBy("doc_id").collect()
    assert [r.dedup.n_bytes > r.dedup.n_removed for r in got] == [True, False, False] and all(r.spans == "spans" and r._cut == "_cut" for r in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_texts")]


def test_paragraph_dedup_frame(spark):
    rng = random.Random(7)
    para = lambda: " ".join(f"w{rng.randrange(2000)}" for _ in range(60))
    shared = para()
    near = shared.split()
    near[30] = "other"
    texts = EDGES[:6] + [f"{para()}\n{shared}", f"{shared}\n{para()}", f"{para()}\n{' '.join(near)}\nkısa satır", f"{para()}\nkısa satır", shared.upper()]
    df = frame(spark, texts)
    for limit in (32, 1):
        out = {r.doc_id: r for r in paragraphs.dedup_paragraphs(df, pair_limit=limit).collect()}
        assert out[6].text == texts[6] and out[6].dedup.n_removed == 0
        assert out[7].text == texts[7].split("\n")[1] and list(out[7].dedup.lines) == [0] and out[7].dedup.n_removed == 60
        assert out[8].text == texts[8].split("\n")[0] + "\nkısa satır" and out[9].text == texts[9] and out[10].text == ""
        assert out[0].text is None and out[0].dedup.n_removed == 0 and out[4].text == out[5].text == "aynı metin burada"
    assert paragraphs.dedup_paragraphs(df.limit(0)).count() == 0


def brute_hits(text, items, n=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(n, len(b))
        cuts = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if b and tuple(w[i : i + size]) in cuts:
                hit |= set(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_frame(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [rng.choice(["Ali", "ve", "ÉTÉ", "été", "İki", "K", "3x"]) + str(rng.randrange(6)) for _ in range(n)]
    a, b, c = words(40), words(25), words(4)
    items = [(1, " ".join(a)), (2, "-".join(b)), (3, " ".join(c)), (4, None), (5, "..."), (None, " ".join(a[:12])), (6, " ".join(a[5:20])), (6, " ".join(a[5:20]))]
    texts = EDGES + [" ".join(words(20) + a[3:30] + words(9)), " ".join(a).upper(), "! " + ", ".join(words(5) + b[2:11]), " ".join(b[1:11] + b[1:11]), " ".join(words(3) + c + words(2) + c), " ".join(a)]
    df = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (common.MAX_BROADCAST, 0):
        monkeypatch.setattr(common.sized, "__defaults__", (most,))
        got = decontam.decontaminate(df, bench).collect()
        assert sorted((r.hits.n_words, r.hits.n_hit, list(r.hits["items"]), r.hits.n_items) for r in got) == sorted((*brute_hits(t, items), len(brute_hits(t, items)[2])) for t in texts)
    assert decontam.decontaminate(df, bench.limit(0)).agg(F.sum("hits.n_hit")).first()[0] == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


def test_decontamination_of_letters_whose_case_depends_on_neighbours(spark):
    """Only A-Z are lower-cased: a copy of an item is hit whatever its letters are; names clash with all that is joined."""
    item = "\u0391\u03a3'\u0391 \u0130stanbul \u212a \u03a3 \u03a3\u03a3. \u00df ONE Two three four five six"
    names = "key t fp mark s len wid seeds n_hit items hits w n p h off at wids _c0 _c1 _hits _told".split()
    df = spark.createDataFrame([(1, item, *names), (2, item.replace("ONE", "oNe"), *names), (3, item.lower(), *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for part in (names[:11], names[11:]):
        got = {r.doc_id: r.hits for r in decontam.decontaminate(df.select("doc_id", "text", *part), bench).collect()}
        want = {i: brute_hits(t, [(7, item)]) for i, t in enumerate((item, item.replace("ONE", "oNe"), item.lower()), 1)}
        assert {i: (h.n_words, h.n_hit, list(h["items"])) for i, h in got.items()} == want and want[1][1] == want[2][1] > 10


def test_mixing_frame(spark):
    rng = random.Random(9)
    en = [" ".join(rng.choice(["the", "thing", "which", "why", "how"]) for _ in range(50)) for _ in range(60)]
    fr = [" ".join(rng.choice(["été", "où", "ça", "bébé", "que"]) for _ in range(30)) for _ in range(30)]
    df = frame(spark, EDGES + en + fr)
    n = len(EDGES)
    labels = spark.createDataFrame([(i + n, "en" if i < 60 else "fr") for i in range(90)] + [(None, "en"), (3, None)], "doc_id long, domain string")
    out = mixing.mix(df, labels, {"en": 0.5, "fr": 0.5, "xx": 1.0}).collect()
    tokens = {d: sum(r.tokens * r.rate for r in out if r.domain == d) for d in ("en", "fr")}
    assert abs(tokens["en"] / sum(tokens.values()) - 0.5) < 0.02 and min(r.rate for r in out) >= 0
    assert all(abs(r.copies - r.rate) < 1 for r in out) and len(out) == len(EDGES) + 90
    assert {r.domain for r in mixing.mix(df, labels.limit(0), {}).collect()} == {"all"}
    assert mixing.mix(df.limit(0), labels, {"en": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.posteriors(df, labels, max_domains=1)


def test_mixing_learns_and_solves_least_squares(spark):
    """Held-out domains are told apart by learned sequences; the rates meet the conditions of the least-squares optimum."""
    import numpy as np

    rng = random.Random(12)
    words = {"x": ["thi", "oth", "the"], "y": ["sch", "ein", "auf"], "z": ["que", "les", "eau"]}
    kinds = [rng.choice("xyz") for _ in range(240)]
    texts = [" ".join(rng.choice(words[k]) + rng.choice("aeiou") for _ in range(rng.randrange(1, 80))) for k in kinds]
    df = frame(spark, texts)
    told = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 4 == 0 and i != 1], "doc_id long, domain string")
    out = {r.doc_id: r for r in mixing.mix(df, told, {"x": 0.6, "y": 0.3, "z": 0.1}).collect()}
    assert sum(out[i].domain == k for i, k in enumerate(kinds) if i % 4 and i != 1) >= 0.97 * sum(1 for i in range(240) if i % 4 and i != 1)
    assert all(r.converged and abs(r.reached_share - r.target_share) < 1e-4 for r in out.values())
    # targets that no rates meet: one domain has no document
    soft, _ = mixing.posteriors(df, told)
    soft = soft.withColumn("p0", F.col("p0") + F.col("p2") * 0.5).withColumn("p2", F.col("p2") * 0.5)
    for weights in ([0.2, 0.3, 0.5], [0.0, 0.0, 1.0]):
        rated, targets, reached, converged = mixing.fit_rates(soft, weights, rounds=5000)
        rows = rated.collect()
        a = np.array([[r["_t"] * r[f"p{d}"] for d in range(3)] for r in rows])
        rate = np.array([r["_rate"] for r in rows])
        assert converged and (rate >= 0).all() and np.allclose(rate @ a, reached)
        p = np.array([[r[f"p{d}"] for d in range(3)] for r in rows])
        slope = p @ np.linalg.solve(a.T @ p + 1e-9 * np.eye(3), rate @ a - np.array(targets))  # of the weighted squared distance, by token
        assert slope.min() > -0.02 and np.abs(slope[rate > 1e-9]).max() < 0.02


def test_html_frame(spark):
    rng = random.Random(10)
    page = lambda body: f"<html><body><div><p>Welcome to the site</p><div><p>{body}</p></div><p>All rights</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(f"story {i} {rng.random()}"), "x") for i in range(8)]
    rows += [(20, None, None, "x"), (21, "", "", "x"), (22, "http://one.example", page("single"), "x"), (23, "http://one.example/b", page("single"), "x"), (24, "http://h.example/24", "<article><p>Welcome to the site</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slot string")
    got = {r.page_id: r.main_text for r in html_wrapper.extract(df).collect()}
    assert all(got[i].startswith("story") and "\n" not in got[i] for i in range(8))
    assert got[20] == got[21] == "" and got[22] == got[23] == "Welcome to the site\nsingle\nAll rights" and got[24] == "Welcome to the site"
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_html_template_inside_the_article(spark):
    """Text that is the same on all pages of a host goes, inside a marked article too; near copies of articles say nothing."""
    page = lambda body: f"<main><h1>About {body}</h1><p>Read our other stories</p><p>{body} said so, and more on {body} follows.</p></main>"
    rows = [(i, f"http://a.example/{i}", page(f"story {i}")) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", page("the one") + f"<!-- {i} -->") for i in range(12)]
    rows += [(200 + i, f"http://few.example/{i}", page(f"story {i}")) for i in range(6)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in range(3):  # every name that the operator joins or adds
        clash = df.selectExpr("*", *[f"'x' AS {c}" for c in ("_host _shape _ref _h".split(), "_s _at _rh _ra".split(), "_blocks _fixed n slot at r main_text".split())[n]])
        got = {r.page_id: r.main_text for r in html_wrapper.extract(clash).collect()}
        assert all(got[i] == f"About story {i}\nstory {i} said so, and more on story {i} follows." for i in range(12))
        assert all("Read our other stories" in got[i] for i in got if i >= 100)
    reached = sum(1 for r in rows for b in html_wrapper.blocks(r[2], rows[3][2]) if b[0] >= 0)
    assert reached == 3 * len(rows)


def test_classifier_frames(spark):
    df = frame(spark, EDGES + ["iyi metin " * 20, "kötü!! *** " * 20])
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    q = quality.score(df, quality.train(df, labels), out="s").collect()
    t = toxicity.score(df, toxicity.train(df, labels), out="s").collect()
    assert len(q) == len(t) == len(EDGES) + 2 and all(0 <= r.s <= 1 for r in [*q, *t])
    none = labels.limit(0)
    assert {r.s for r in quality.score(df, quality.train(df, none), out="s").collect()} == {0.5}
    assert {r.s for r in toxicity.score(df, toxicity.train(df, none), out="s").collect()} == {0.5}
    assert quality.score(df.limit(0), quality.train(df, labels)).count() == 0


def test_language_frame(spark):
    df = frame(spark, EDGES).withColumn("lang", F.when(F.col("text") == "kısa", "tr"))
    got = {r.doc_id: r.lang_id for r in langid.identify(df, langid.train(df)).collect()}
    assert got[0].lang_pred == "und" and got[0].score == 0 and got[3].lang_pred == "tr" and got[6].lang_pred == "tr"
    assert {r.lang_id.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.train(df)).count() == 0


def test_media_frame(spark):
    got = media_ogg.media_digest(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.media.error is None for r in got) and got[0].media.payload_bytes == 576
    stored = media_ogg.media_column(frame(spark, EDGES)).collect()
    assert all(media_ogg.load(bytes(r.media))[0] == media_ogg.payload_of(r.text)[1] for r in stored)
    assert media_ogg.media_digest(frame(spark, EDGES).limit(0)).count() == 0


def test_large_bucket_keeps_its_component(spark):
    """Copies with one changed word each, with and without their base; the buckets are far over the limit."""
    texts = []
    for c in "vw":
        base = [f"{c}{i}" for i in range(60)]
        texts += [" ".join(base[:i] + [f"x{n}y{i}"] + base[i + 1 :]) for n in range(3) for i in range(10, 50, 2)]
    texts.append(" ".join(base))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    hashed = [paragraphs.word_hashes(t.split()) for t in texts]
    bands = paragraphs.band_keys(hashed).tolist()
    keys = [set(k) for k in bands]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if g == b else g for g in want]
    df = spark.createDataFrame(list(enumerate(bands)), "pid long, keys array<bigint>")
    sets = spark.createDataFrame([(i, paragraphs.shingle_hashes([u])[0].view("int64").tolist()) for i, u in enumerate(hashed)], "pid long, s array<bigint>")
    got = {r.pid: r.comp for r in paragraphs.clusters(df, lambda ids: sets.join(ids, "pid"), pair_limit=8).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_passage_inside_longer_lines(spark):
    """A passage of over 50 words goes wherever it repeats, whatever surrounds it and however it is broken."""
    passage = [f"p{i}" for i in range(52)]
    def around(c, n):
        return [f"{c}{i}" for i in range(n)]
    one = " ".join(around("a", 70) + passage + around("b", 70))
    two = " ".join(around("c", 40) + passage[:20]) + "\n" + " ".join(passage[20:] + around("d", 90))
    short = " ".join(around("e", 60) + passage[:40] + around("f", 60))
    df = spark.createDataFrame([(1, one), (2, two), (3, short), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(df).collect()}
    assert got == {1: one, 2: " ".join(around("c", 40)) + "\n" + " ".join(around("d", 90)), 3: short, 4: None}


def test_pipeline_drops_near_copies(spark):
    """Near copies by 5-word Jaccard 0.8 go, though their fingerprints differ in more than 2 bits; others stay."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(120)]
    near = base[:60] + ["new"] + base[61:]
    far = [x if i % 12 else "other" for i, x in enumerate(base)]
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 2
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, near, far, base])], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 2]


def test_passages_by_brute_force(spark):
    """All runs of 50 words that occurred before go, and nothing else; texts are quilted from shared runs of 20 to 90 words."""
    rng = random.Random(11)
    pool = [[f"s{i}x{j}" for j in range(200)] for i in range(4)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"d{d}w{rng.randrange(9999)}" for _ in range(rng.randrange(40))]
            run, at = rng.choice(pool), rng.randrange(110)
            words += run[at : at + rng.randrange(20, 91)]
        rows.append((d if d % 7 else None, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.dedup.n_removed, r.text) for r in paragraphs.dedup_paragraphs(df, min_words=10_000).collect())
    key = {r.text: r.x for r in df.selectExpr("text", "xxhash64(text) AS x").collect()}
    seen, want = set(), []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]])):
        words = text.split()
        drop = [False] * len(words)
        for i in range(len(words) - 49):
            run = tuple(words[i : i + 50])
            if run in seen:
                drop[i : i + 50] = [True] * 50
            seen.add(run)
        want.append((k or 0, sum(drop), " ".join(w for w, g in zip(words, drop, strict=True) if not g)))
    assert got == sorted(want) and sum(n for _, n, _ in want) > 500


def test_paragraph_dedup_clashing_names_and_repeats(spark):
    line = " ".join(f"w{i}" for i in range(60))
    names = ["k", "x", "t", "k2", "x2", "pid", "comp", "removed", "starts", "place", "lead", "dedup", "n", "keys", "h", "pos", "_c0", "_mark", "_cut"]
    df = spark.createDataFrame([(1, line, *names), (1, line, *names), (2, f"{line}\nkalan", *names), (None, line, *names)], ["doc_id", "text", *names])
    got = paragraphs.dedup_paragraphs(df).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.text) for r in got] == [(None, line), (1, ""), (1, ""), (2, "kalan")] and all(r.removed == "removed" and r.starts == "starts" for r in got)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_edges(spark, tmp_path, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables."""
    import corpus_pipeline

    good = " ".join(f"word{i % 89} and" for i in range(300))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (1, "another text of the same key", "en", "a", 1), (None, None, None, None, None), (2, "", "fr", "b", 0), (None, "kısa", "fr", None, 3), (3, LONG, "de", "c", None)]
    names = "hits dedup _score _copy _row k x p0 _t lang2 _c0 _r0 comp n_hit removed fp".split()
    df = spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    spark.createDataFrame([(7, "none of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, df, str(tmp_path)).collect()
    # near copies: the repeated row goes, and null and empty text are one; equal rows are one document to the paragraph stage
    assert len(got) == {"quality": 7, "simhash": 5, "paragraphs": 7, "decontamination": 7, "mixing": 7}[name]
    if name != "mixing":
        assert got[0].asDict().keys() == set(df.columns) and all(r.hits == "hits" and r._copy == "_copy" and r._c0 == "_c0" for r in got)
    assert run(spark, df.limit(0), str(tmp_path)).count() == 0
