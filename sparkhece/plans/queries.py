"""The registered queries of the reference's own operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkhece.functions import case, text
from sparkhece.functions.rules import ACCENT, EMAIL, HASHTAG, MENTION, URL
from sparkhece.operators import evaluate, mltok, normalize, sentences, stem, stopwords, tokenize
from sparkhece.plans import samples, services, source_queries
from sparkhece.register import register
from sparkhece.sources import lexicons
from sparkhece.sources.shared import stored
from sparkhece.streaming import corpus

IDF, DF, TF, TFIDF = 5.65, 0.15, 0.01, 0.20  # thresholds of the list queries


def _t(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str, n: int = 9) -> Column:
    return F.round(c, n)


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pieces between blanks of all documents."""
    return _t(spark, sf).select(F.explode(text.spaced_tokens("text")).alias("token")).distinct()


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct corpus words of all documents, as a lexicon; stored, as plans read it several times."""
    return stored(_t(spark, sf).select(F.explode(text.corpus_tokens("text")).alias("word")).distinct(), "vocabulary")


def _stop(spark: SparkSession, sf: str) -> list[str]:
    return stopwords.word_array(stopwords.by_df(stopwords.frequencies(_t(spark, sf)), DF))


def _stemmer(spark: SparkSession, sf: str) -> stem.Stemmer:
    """Sample suffixes; the lexicon is the corpus words of the benchmark table (a small table)."""
    words = _t(spark, sf, "benchmark").select(F.explode(text.corpus_tokens("text")).alias("w")).distinct()
    return stem.Stemmer(dict(samples.SUFFIXES), frozenset(stopwords.word_array(words, "w")))


def corpus_tokens(spark, sf):
    return tokenize.explode_tokens(_t(spark, sf), text.corpus_tokens("text"), ["doc_id"])


def term_frequency(spark, sf):
    return stopwords.terms(_t(spark, sf)).select("doc_id", "word", "cnt", _r("tf").alias("tf"))


def frequency(column: str):
    def run(spark, sf):
        c = F.col(column) if column == "df" else _r(column).alias(column)
        return stopwords.frequencies(_t(spark, sf)).select("word", c)

    return run


def tfidf(spark, sf):
    return stopwords.tfidf(_t(spark, sf)).select("doc_id", "word", _r("tf").alias("tf"), _r("idf").alias("idf"), _r("tfidf").alias("tfidf"))


def stop_list(pick, threshold, column):
    def run(spark, sf):
        return pick(stopwords.frequencies(_t(spark, sf)), threshold).select("word", _r(column).alias(column))

    return run


def stop_combined(spark, sf):
    return stopwords.combined(stopwords.frequencies(_t(spark, sf)), IDF, DF)


def idf_extremes(spark, sf, lowest=True):
    out = stopwords.extremes(stopwords.frequencies(_t(spark, sf)), 50, lowest)
    return out.select("word", "df", _r("idf").alias("idf"), _r("pct", 6).alias("pct"))


def stop_filter(spark, sf):
    return _t(spark, sf).select("doc_id", stopwords.remove_stopwords("text", _stop(spark, sf)).alias("filtered"))


def stop_filter_join(spark, sf):
    list_ = stopwords.by_df(stopwords.frequencies(_t(spark, sf)), DF).select("word")
    return stopwords.remove_by_join(corpus_tokens(spark, sf), list_).select("doc_id", "pos", "token")


def stop_service(spark, sf):
    out = services.remove_stopwords(_t(spark, sf).select("doc_id", "text"), _stop(spark, sf), mode="clean")
    return out.select("doc_id", F.array_join("filtered_tokens", " ").alias("filtered"), F.array_join("unique_tokens", " ").alias("unique_filtered"), F.array_join("removed_stopwords", " ").alias("removed"), "original_count", "filtered_count", "removed_count")


def stop_evaluation(spark, sf):
    """Vocabulary and token reduction, lengths and coverage of the derived stop words."""
    stop = _stop(spark, sf)
    both = _t(spark, sf).select(text.corpus_tokens("text").alias("a")).withColumn("b", stopwords.keep(F.col("a"), stop))
    sums = both.agg(F.sum(F.size("a")).alias("tokens_before"), F.sum(F.size("b")).alias("tokens_after"), _r(F.avg(F.size("a")), 6).alias("avg_before"), _r(F.avg(F.size("b")), 6).alias("avg_after"), *evaluate.coverage(F.col("a"), stop))
    va = evaluate.vocabulary(both.select(F.explode("a").alias("token"))).withColumnRenamed("vocabulary", "vocab_before")
    vb = evaluate.vocabulary(both.select(F.explode("b").alias("token"))).withColumnRenamed("vocabulary", "vocab_after")
    one = sums.crossJoin(F.broadcast(va)).crossJoin(F.broadcast(vb))  # three single rows
    return one.select("*", _r(evaluate.reduction(F.col("tokens_before"), F.col("tokens_after")), 6).alias("token_reduction_pct"), _r(evaluate.reduction(F.col("vocab_before"), F.col("vocab_after")), 6).alias("vocab_reduction_pct")).withColumn("coverage_pct", _r("coverage_pct", 6))


def list_difference(spark, sf):
    f = stopwords.frequencies(_t(spark, sf))
    return evaluate.difference_size(stopwords.by_idf(f, IDF).select("word"), stopwords.by_df(f, DF).select("word"))


def on_words(**columns):
    def run(spark, sf):
        return _words(spark, sf).select("token", *[f("token").alias(k) for k, f in columns.items()])

    return run


def case_samples(spark, sf):
    t = samples.frame(spark, samples.CASES, "token string")
    return t.select("token", case.case_transform("token").alias("transformed"), case.is_proper("token").alias("proper"), case.match_case(F.lit("kâğıt"), "token").alias("matched"))


def tokenize_clean(spark, sf):
    return tokenize.explode_tokens(_t(spark, sf), tokenize.rule_tokens("text", mode="clean"), ["doc_id"])


def tokenize_rule(spark, sf):
    return tokenize.explode_tokens(_t(spark, sf, "benchmark"), tokenize.rule_tokens("text"), ["item_id"])


def tokenize_compat(spark, sf):
    return tokenize.explode_tokens(_t(spark, sf), tokenize.rule_tokens("text", ["of the", "de la"]), ["doc_id"])


def tokenize_unique(spark, sf):
    return tokenize.explode_tokens(_t(spark, sf, "benchmark"), text.unique(tokenize.rule_tokens("text")), ["item_id"])


def entities(spark, sf):
    """How many entities of each kind every document holds."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    return _t(spark, sf).select("doc_id", n(URL).alias("urls"), n(EMAIL).alias("emails"), n(HASHTAG).alias("hashtags"), n(MENTION).alias("mentions"))


def abbrev_tokens(spark, sf):
    return normalize.expand_abbreviations(_words(spark, sf), samples.frame(spark, samples.ABBREV, "abbr string, full_form string"))


def abbrev_text(spark, sf):
    table = samples.frame(spark, samples.ABBREV, "abbr string, full_form string")
    return normalize.expand_text(_t(spark, sf).select("doc_id", "text"), table).select("doc_id", "expanded")


def accent_group(name):
    def run(spark, sf):
        return samples.frame(spark, samples.COLLOQUIAL, "token string").select("token", text.accent("token", None if name == "full" else [name]).alias("standard"))

    return run


def accent_words(spark, sf):
    return _words(spark, sf).select("token", text.accent("token").alias("standard"))


def diacritics(spark, sf):
    lex = _vocabulary(spark, sf)
    words = lex.select(text.fold("word").alias("token")).distinct()
    return normalize.restore_diacritics(words, lex).select("token", "restored")


def diacritics_text(spark, sf):
    lex = _vocabulary(spark, sf)
    work = lambda t: normalize.restore_diacritics(t, lex, "token", "_new")
    return normalize.rewrite_words(_t(spark, sf, "benchmark").select("item_id", "text"), "text", "item_id", work, ".", "corrected").select("item_id", "corrected")


def diacritic_scores(spark, sf):
    lex = _vocabulary(spark, sf)
    return lex.select("word", text.candidate_score("word", F.length("word") > 3).alias("score"))


def corrections(spark, sf):
    return normalize.correct_by_list(_words(spark, sf))


def diacritic_variants(spark, sf):
    words = _t(spark, sf, "benchmark").select(F.explode(text.corpus_tokens("text")).alias("token")).distinct()
    return words.select("token", F.posexplode(normalize.variants_column("token")).alias("pos", "variant"))


def segments(spark, sf):
    return _vocabulary(spark, sf).select("word", F.array_join(text.segments("word"), "-").alias("segments"))


def vowels(spark, sf):
    lex = _vocabulary(spark, sf)
    words = lex.select(text.consonants("word").alias("token")).where("token <> ''").distinct()
    return normalize.restore_vowels(words, lex).select("token", "restored", text.vowel_additions("token", "restored").cast("int").alias("added"))


def spelling(spark, sf):
    words = samples.frame(spark, samples.MISSPELLED, "token string")
    return normalize.correct_spelling(words, samples.frame(spark, samples.LEXICON, "word string, freq long"))


def spelling_goldens(spark, sf):
    """The fixed pairs against a lexicon of their right forms."""
    pairs = samples.frame(spark, samples.SPELLING, "token string, expected string")
    lex = pairs.groupBy(F.col("expected").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return normalize.correct_spelling(pairs, lex).select("token", "expected", "corrected", evaluate.status(F.col("corrected"), F.col("expected")).alias("status"))


def spelling_corpus(spark, sf):
    """One edit; words of the conversations against the documents' words and their counts."""
    lex = _t(spark, sf).select(F.explode(text.corpus_tokens("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    words = _t(spark, sf, "conversations").select(F.explode(text.corpus_tokens("text")).alias("token")).distinct()
    return normalize.correct_spelling(words, lex, distance=1)


def error_model(spark, sf):
    out = normalize.error_model(samples.frame(spark, samples.ERROR_PAIRS, "wrong string, correct string"))
    return out.select("pattern", "n", _r("cost", 6).alias("cost"))


def stems(spark, sf):
    return tokenize.on_distinct(_vocabulary(spark, sf).withColumnRenamed("word", "token"), "token", lambda d: d.withColumn("stem", stem.stem_column("_v", _stemmer(spark, sf))), "stem")


def stem_details(spark, sf):
    out = _vocabulary(spark, sf).select("word", stem.details_column("word", _stemmer(spark, sf)).alias("d"))
    return out.select("word", "d.stem", F.array_join("d.removed_suffixes", "+").alias("removed"), F.array_join("d.suffix_categories", "+").alias("categories"), "d.score", "d.valid", F.size("d.alternative_stems").alias("alternatives"), "d.total_paths_explored")


def suffix_statistics(spark, sf):
    out = stem.category_statistics(samples.frame(spark, samples.SUFFIXES, "suffix string, category string"))
    return out.select("category", "n", _r("percentage", 6).alias("percentage"), F.array_join("examples", ",").alias("examples"))


def sentences_rule(spark, sf, mode="compat"):
    return _t(spark, sf).select("doc_id", F.posexplode(sentences.rule_sentences("text", mode)).alias("sent_no", "sentence"))


def nb_features(spark, sf):
    return sentences.nb_features(_t(spark, sf, "benchmark"), "text", ["item_id"])


def _nb_tables(spark, sf):
    lines = _t(spark, sf, "benchmark").select("item_id", F.posexplode(sentences.rule_sentences("text", "clean")).alias("n", "sentence"))
    lines = lines.select(F.col("item_id"), (F.col("item_id") * 1000 + F.col("n")).alias("line_no"), "sentence")
    return sentences.nb_train(sentences.nb_examples(lines, group="item_id"))


def nb_model(spark, sf):
    features, _ = _nb_tables(spark, sf)
    return features.select("class", "feature", "n")


def sentences_nb(spark, sf):
    return sentences.nb_split(_t(spark, sf), "text", ["doc_id"], sentences.nb_weights(*_nb_tables(spark, sf)))


def char_features(spark, sf):
    return mltok.char_features(_t(spark, sf, "benchmark"), "text", ["item_id"])


def tokenize_ml(spark, sf):
    gold = _t(spark, sf, "benchmark").select("item_id", "text", tokenize.rule_tokens("text").alias("tokens"))
    model = mltok.train(mltok.labelled(gold, keys=["item_id"]), iterations=30)
    out = mltok.tokenize(_t(spark, sf, "conversations").select("conv_id", "turn", "text"), model, keys=["conv_id", "turn"])
    return out.select("conv_id", "turn", F.array_join("tokens", "␟").alias("tokens"))


def _scored(spark, sf, distinct=False):
    p, g = text.corpus_tokens("text"), tokenize.rule_tokens("text", mode="clean")
    return _t(spark, sf).select("doc_id", evaluate.token_scores(p, g, distinct).alias("scores"))


def token_scores(spark, sf, distinct=False):
    s = _scored(spark, sf, distinct)
    return s.select("doc_id", "scores.exact", *[_r(f"scores.{k}").alias(k) for k in ("precision", "recall", "f1")])


def token_macro(spark, sf):
    m = evaluate.macro(_scored(spark, sf))
    return m.select("n", "errors", *[_r(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def token_report(spark, sf):
    return evaluate.report(evaluate.macro(_scored(spark, sf)))


def attempts(spark, sf):
    """Case counts of words by a rule that fails on words without vowels: those rows are errors."""
    words = _t(spark, sf, "benchmark").select(F.explode(text.corpus_tokens("text")).alias("token")).distinct()
    done = words.withColumn("output", evaluate.attempt(lambda w: next(c for c in w if c in "aeıioöuü"), "token"))
    return done.select("token", "output", evaluate.status(F.col("output"), F.substring("token", 1, 1)).alias("status"))


def token_compare(spark, sf):
    out = evaluate.compare(evaluate.macro(_scored(spark, sf)), evaluate.macro(_scored(spark, sf, True)), ("list", "set"))
    return out.select("metric", _r("first", 6).alias("first"), _r("second", 6).alias("second"), "winner")


def token_errors(spark, sf):
    return evaluate.first_errors(_scored(spark, sf), "doc_id").select("doc_id", _r("scores.f1").alias("f1"))


def _pairs(spark):
    return samples.frame(spark, samples.ACCURACY, "input string, expected string")


def _lex(spark):
    return samples.frame(spark, samples.LEXICON, "word string, freq long")


def normalize_accuracy(spark, sf):
    done = normalize.normalize_words(_pairs(spark), _lex(spark), column="input", out="output")
    return evaluate.accuracy(done)


def normalize_status(spark, sf):
    done = normalize.normalize_words(_pairs(spark), _lex(spark), column="input", out="output")
    return done.select("input", "output", "expected", evaluate.status(F.col("output"), F.col("expected")).alias("status"))


def ablation(spark, sf):
    rows = None
    for name in ("full", *normalize.MODULES):
        done = normalize.normalize_words(_pairs(spark), _lex(spark), column="input", out="output", disabled=(name,)).withColumn("config", F.lit(name if name == "full" else f"no_{name}"))
        rows = done if rows is None else rows.unionByName(done)
    return evaluate.ablation(rows)


def morph_parse(spark, sf):
    return lexicons.morph_rows(samples.frame(spark, [(1, samples.MORPH)], "doc_id long, text string"))


def proper_nouns(spark, sf):
    words = samples.frame(spark, [("Ali", "ali"), ("okudu", "okudu"), ("kitabı", "kitabı")], "token string, normalized string")
    return normalize.capitalize_proper(words, morph_parse(spark, sf))


def _joined(column):
    return F.array_join(column, "␟").alias(column)


def service_sentences(spark, sf):
    return services.split_sentences(_t(spark, sf).select("doc_id", "text"), mode="clean").select("doc_id", "sentence_count", services.numbered("sentences").alias("shown"))


def service_sentences_nb(spark, sf):
    model = sentences.nb_weights(*_nb_tables(spark, sf))
    return services.split_sentences_nb(_t(spark, sf).select("doc_id", "text"), model).select("doc_id", "sentence_count", _joined("sentences"))


def service_tokenize(spark, sf):
    return services.tokenize_rule(_t(spark, sf, "conversations")).select("conv_id", "turn", _joined("tokens"), _joined("unique_tokens"))


def service_stem(spark, sf):
    return services.stem(_t(spark, sf, "benchmark"), _stemmer(spark, sf), key="item_id").select("item_id", _joined("results"))


def service_normalize(spark, sf):
    docs = _t(spark, sf, "benchmark").select("item_id", "text")
    lex = _vocabulary(spark, sf)
    return services.normalize(docs, lex, samples.frame(spark, samples.ABBREV, "abbr string, full_form string"), key="item_id", disabled=("spelling",)).select("item_id", _joined("results"))


def normalize_sequences(spark, sf):
    docs = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = normalize.normalize_sequences(docs, text.spaced_tokens("text"), _vocabulary(spark, sf), disabled=("spelling", "vowels"))
    return out.select("doc_id", _joined("normalized"))


def normalize_text(spark, sf):
    docs = _t(spark, sf, "benchmark").select("item_id", "text")
    return normalize.normalize_text(docs, _vocabulary(spark, sf), key="item_id", disabled=("spelling", "vowels"))


def streaming_df(spark, sf):
    return corpus.run_available(corpus.document_frequency(corpus.read_documents(spark, f"{sf}/documents.parquet")))


def windowed_df(spark, sf):
    """Document frequencies by day, where a document comes every hour."""
    docs = corpus.read_documents(spark, f"{sf}/documents.parquet").withColumn("at", F.timestamp_seconds(F.col("doc_id") * 3600))
    out = corpus.run_available(corpus.windowed_frequency(docs, "at"))
    return out.select((F.unix_timestamp("window.start") / 86400).cast("long").alias("day"), "word", "df")


def service_tokenize_ml(spark, sf):
    gold = _t(spark, sf, "benchmark").select("item_id", "text", tokenize.rule_tokens("text").alias("tokens"))
    model = mltok.train(mltok.labelled(gold, keys=["item_id"]), iterations=30)
    out = services.tokenize_ml(gold.select("item_id", "text"), model, key="item_id")
    return out.select("item_id", _joined("tokens"), _joined("unique_tokens"))


def sql_functions(spark, sf):
    register(spark)
    _t(spark, sf, "conversations").createOrReplaceTempView("sparkhece_conversations")
    return spark.sql(
        "SELECT conv_id, turn, tr_lower(text) AS low, tr_upper(text) AS up, size(tr_tokens(text)) AS n_tokens, tr_fold(text) AS folded FROM sparkhece_conversations"
    )


def sql_sentences(spark, sf):
    register(spark)
    _t(spark, sf, "benchmark").createOrReplaceTempView("sparkhece_benchmark")
    return spark.sql("SELECT b.item_id, s.sent_no, s.sentence FROM sparkhece_benchmark b, LATERAL tr_sentences(b.text) s")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "corpus_tokens": corpus_tokens,
    "term_frequency": term_frequency,
    "document_frequency": frequency("df"),
    "idf": frequency("idf"),
    "avg_tf": frequency("avg_tf"),
    "avg_tfidf": frequency("avg_tfidf"),
    "tfidf": tfidf,
    "stopwords_by_idf": stop_list(stopwords.by_idf, IDF, "idf"),
    "stopwords_by_df": stop_list(stopwords.by_df, DF, "df_share"),
    "stopwords_by_tf": stop_list(stopwords.by_tf, TF, "avg_tf"),
    "stopwords_by_tfidf": stop_list(stopwords.by_tfidf, TFIDF, "avg_tfidf"),
    "stopwords_combined": stop_combined,
    "idf_extremes": idf_extremes,
    "idf_highest": partial(idf_extremes, lowest=False),
    "stopword_filter": stop_filter,
    "stopword_filter_join": stop_filter_join,
    "stopword_service": stop_service,
    "stopword_evaluation": stop_evaluation,
    "list_difference": list_difference,
    "tr_lower": on_words(lowered=case.tr_lower),
    "tr_upper": on_words(uppered=case.tr_upper),
    "tr_capitalize": on_words(capitalized=case.tr_capitalize),
    "case_predicates": on_words(lower=case.is_lower, upper=case.is_upper, proper=case.is_proper),
    "case_transform": on_words(transformed=case.case_transform),
    "case_samples": case_samples,
    "tokenize_clean": tokenize_clean,
    "tokenize_rule": tokenize_rule,
    "tokenize_compat": tokenize_compat,
    "tokenize_unique": tokenize_unique,
    "entities": entities,
    "abbrev_tokens": abbrev_tokens,
    "abbrev_text": abbrev_text,
    **{f"accent_{n}": accent_group(n) for n in ("full", *ACCENT)},
    "accent_words": accent_words,
    "diacritics": diacritics,
    "diacritics_text": diacritics_text,
    "diacritic_scores": diacritic_scores,
    "corrections": corrections,
    "diacritic_variants": diacritic_variants,
    "segments": segments,
    "vowels": vowels,
    "spelling": spelling,
    "spelling_goldens": spelling_goldens,
    "spelling_corpus": spelling_corpus,
    "error_model": error_model,
    "stems": stems,
    "stem_details": stem_details,
    "suffix_statistics": suffix_statistics,
    "sentences_rule": sentences_rule,
    "sentences_clean": partial(sentences_rule, mode="clean"),
    "nb_features": nb_features,
    "nb_model": nb_model,
    "sentences_nb": sentences_nb,
    "char_features": char_features,
    "tokenize_ml": tokenize_ml,
    "token_scores": token_scores,
    "token_scores_set": partial(token_scores, distinct=True),
    "token_macro": token_macro,
    "token_report": token_report,
    "attempts": attempts,
    "token_compare": token_compare,
    "token_errors": token_errors,
    "normalize_accuracy": normalize_accuracy,
    "normalize_status": normalize_status,
    "ablation": ablation,
    "morph_parse": morph_parse,
    "proper_nouns": proper_nouns,
    "service_sentences": service_sentences,
    "service_sentences_nb": service_sentences_nb,
    "service_tokenize": service_tokenize,
    "service_stem": service_stem,
    "service_normalize": service_normalize,
    "normalize_sequences": normalize_sequences,
    "normalize_text": normalize_text,
    "streaming_df": streaming_df,
    "windowed_df": windowed_df,
    "service_tokenize_ml": service_tokenize_ml,
    "sql_functions": sql_functions,
    "sql_sentences": sql_sentences,
    **source_queries.QUERIES,
}
