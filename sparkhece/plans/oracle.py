"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from sparkhece.functions import rules
from sparkhece.plans import samples, search_oracle, source_queries
from sparkhece.plans.samples import values

_W = r"[\p{L}\p{N}_]"


def _tok(table: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, list_filter(regexp_extract_all(lower(translate(text, 'Iİ', 'ıi')), '{_W}+'), "
        f"lambda t: regexp_full_match(t, '[a-zçğıöşü]+')) AS w FROM {table}"
    )


_TERMS = f"""d AS ({_tok()}), tok AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d),
 tf AS (SELECT doc_id, word, count(*) AS cnt, count(*)::DOUBLE / n AS tf FROM tok GROUP BY doc_id, n, word),
 nd AS (SELECT count(*) AS nd FROM documents),
 per AS (SELECT word, count(*) AS df, ln((SELECT nd FROM nd)::DOUBLE / count(*)) AS idf, avg(tf) AS avg_tf, count(*)::DOUBLE / (SELECT nd FROM nd) AS df_share FROM tf GROUP BY word),
 freq AS (SELECT *, avg_tf * idf AS avg_tfidf FROM per)"""
_STOP = f"{_TERMS}, stop AS (SELECT word FROM freq WHERE df_share > 0.15)"
_WORDS = r"""words AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[^\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS token FROM documents))"""


def _lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def _upper(x: str) -> str:
    return f"upper(replace(translate({x}, 'ıi', 'Iİ'), 'ß', 'SS'))"


def _head(x: str) -> str:
    return f"substr({x}, 1, 1)"


def _cap(x: str) -> str:
    return f"({_upper(_head(x))} || {_lower(f'substr({x}, 2)')})"


def _proper(x: str) -> str:
    return f"({x} <> '' AND {_head(x)} = {_upper(_head(x))} AND substr({x}, 2) = {_lower(f'substr({x}, 2)')})"


def _transform(x: str) -> str:
    marked = f"(contains({x}, '''') OR contains({x}, '.'))"
    return (
        f"CASE WHEN {_proper(x)} AND contains({x}, '''') THEN {x} WHEN {x} = {_lower(x)} THEN CASE WHEN {marked} THEN {_cap(x)} ELSE {x} END "
        f"WHEN {_proper(x)} THEN {_lower(x)} WHEN {marked} THEN {_cap(x)} ELSE {_lower(x)} END"
    )


_SPACES = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PIECES = _WORDS.split("'")[1]


def _rule_tokens(table: str, keys: str, entities: bool) -> str:
    """Token lists: pieces between blanks; entities whole, others with their edges peeled character by character."""
    whole = rf"^({rules.URL}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}|[#@]{_W}+)$"
    lead, tail = r"'^([^\p{L}\p{N}_]*)'", r"'([^\p{L}\p{N}_]*)$'"
    rest = f"substr(t, len(regexp_extract(t, {lead}, 1)) + 1)"
    back = f"CASE WHEN {rest} = '' THEN '' ELSE regexp_extract({rest}, {tail}, 1) END"
    core = f"substr({rest}, 1, len({rest}) - len({back}))"
    peel = f"list_concat(regexp_extract_all(regexp_extract(t, {lead}, 1), '(?s).'), CASE WHEN {core} = '' THEN [] ELSE [{core}] END, regexp_extract_all({back}, '(?s).'))"
    made = f"CASE WHEN regexp_matches(t, '{whole}') THEN [t] ELSE {peel} END" if entities else peel
    return f"SELECT {keys}, flatten(list_transform(regexp_extract_all(text, '{_PIECES}'), lambda t: {made})) AS w FROM {table}"


def _exploded(inner: str, key: str) -> str:
    return f"SELECT {key}, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS token FROM ({inner})"


def _accent(x: str, names: list[str]) -> str:
    """On single words: a rule's ending ends the word, so ``\\b`` is an anchor."""
    for name in names:
        for pattern, to in rules.ACCENT[name]:
            body = pattern.replace(r"\w", _W)
            x = f"regexp_replace({x}, '^{body}$', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}')"
    return x


_ORDER = ["negative", "future", "present", "question", "other"]


def _accent_runs(names: list[str]) -> str:
    """Rule by rule over a table, so that the expression does not nest."""
    steps, at = ["s0 AS (SELECT token, token AS v FROM src)"], 0
    for name in names:
        at += 1
        steps.append(f"s{at} AS MATERIALIZED (SELECT token, {_accent('v', [name])} AS v FROM s{at - 1})")
    return f"{', '.join(steps)} SELECT token, v AS standard FROM s{at}"


_FOLD = "translate({}, 'şçğüöıî', 'scguoii')"
_TR = "len({0}) - len(regexp_replace({0}, '[şçğüöıŞÇĞÜÖİ]', '', 'g'))"
_LEX = f"lex AS (SELECT DISTINCT unnest(w) AS word FROM ({_tok()}))"
_FIXES = f"fix AS (SELECT * FROM {values(list(rules.CORRECTIONS.items()), 'wrong, right_form')})"
_SKEL = "regexp_replace({}, '[aeıioöuü]', '', 'g')"

_KNOWN = ", ".join(f"'{a}'" for a in rules.ABBREVIATIONS)
_SENTENCES = rf"""flat AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')) AS t FROM documents),
 ch AS (SELECT doc_id, t, string_split(t, '') AS c FROM flat),
 mk AS (SELECT doc_id, t, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] IN ('.', '!', '?'))) AS i, c FROM ch),
 cx AS (SELECT doc_id, i, c[i] AS m, c[i + 1] AS nx, c[i - 1] AS pv, c[greatest(i - 2, 1)] AS p2,
               lower(regexp_extract(array_to_string(c[greatest(1, i - 200):i - 1], ''), '([\p{{L}}\p{{N}}.]*)$', 1)) AS w,
               ltrim(array_to_string(c[i + 1:i + 8], '')) AS r FROM mk),
 br AS (SELECT doc_id, i,
  (m = '.' AND i > 2 AND pv = '.' AND p2 = '.' AND coalesce(nx, '') <> '.')
  OR (NOT (m = '.' AND (replace(w, '.', '') IN ({_KNOWN}) OR regexp_full_match(replace(w, '.', ''), '\p{{L}}') OR (contains(w, '.') AND len(replace(w, '.', '')) <= 4)))
      AND NOT (m = '.' AND regexp_full_match(coalesce(pv, ''), '\p{{Nd}}') AND regexp_full_match(coalesce(nx, ''), '\p{{Nd}}'))
      AND coalesce(nx, '') NOT IN ('.', '!', '?')
      AND NOT (r[1] = '"' AND ltrim(r[2:]) <> '' AND NOT regexp_matches(ltrim(r[2:]), '^[\p{{Lu}}"''«,]'))) AS cut FROM cx),
 cuts AS (SELECT doc_id, i FROM br WHERE cut UNION SELECT doc_id, len(t) FROM flat WHERE len(t) > 0),
 seg AS (SELECT doc_id, i, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM cuts),
 sent AS (SELECT doc_id, i, trim(t[a + 1:i]) AS sentence FROM seg JOIN flat USING (doc_id)),
 numbered AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sent_no, sentence FROM sent WHERE sentence <> '')"""


def _kind(c: str, marks: bool) -> str:
    punct = f" WHEN {c} IN ('.', '!', '?') THEN 'PUNCT'" if marks else ""
    classes = "".join(f" WHEN regexp_full_match({c}, '{p}') THEN '{k}'" for p, k in ((r"\s", "SPACE"), (r"\p{Lu}", "UPPER"), (r"\p{Ll}", "LOWER"), (r"\p{Nd}", "DIGIT"), (r"""["'']""", "QUOTE")))
    return f"CASE{classes}{punct} ELSE 'OTHER' END"


_NB = rf"""ch AS (SELECT item_id, text AS t, string_split(text, '') AS c FROM benchmark),
 mk AS (SELECT item_id, t, c, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] IN ('.', '!', '?'))) AS i FROM ch),
 cx AS (SELECT item_id, i - 1 AS pos, c[i] AS m, c[i + 1] AS nx, c[i + 2] AS n2, CASE WHEN i > 1 THEN c[i - 1] END AS pv, regexp_extract(substr(t, 1, i - 1), '(\S+)\s*$', 1) AS w, ltrim(regexp_replace(substr(t, i + 1), '^\s+', '')) AS r FROM mk),
 ft AS (SELECT item_id, pos, unnest([
   'curr_char=' || m, 'next_char=' || CASE WHEN nx IS NULL THEN 'END' ELSE {_kind('nx', True)} END,
   CASE WHEN regexp_full_match(nx, '\s') AND n2 IS NOT NULL THEN 'after_space=' || CASE WHEN {_kind('n2', True)} IN ('UPPER', 'LOWER', 'DIGIT', 'PUNCT') THEN {_kind('n2', True)} ELSE 'OTHER' END END,
   'prev_char=' || CASE WHEN pv IS NULL THEN 'START' ELSE {_kind('pv', False)} END,
   'next_word_capital=' || CASE WHEN regexp_matches(r, '^\p{{Lu}}') THEN 'True' ELSE 'False' END,
   CASE WHEN w <> '' THEN 'prev_word=' || CASE WHEN regexp_full_match(regexp_replace(w, '[,.]', '', 'g'), '\p{{Nd}}+') THEN 'NUMBER'
     WHEN len(w) <= 3 AND regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '\p{{Ll}}') THEN 'ABBREV'
     WHEN regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '\p{{Lu}}') THEN 'LOWER' WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'CAPITAL' ELSE 'OTHER' END END]) AS feature FROM cx)
SELECT item_id, pos::INTEGER AS pos, feature FROM ft WHERE feature IS NOT NULL"""

_PUNCT = "'" + rules.PUNCTUATION.replace("'", "''") + "'"


def _flag(c: str, p: str) -> str:
    return f"coalesce(regexp_full_match({c}, '{p}'), false)"


_CHARS = rf"""ch AS (SELECT item_id, string_split(text, '') AS c FROM benchmark),
 e AS (SELECT item_id, unnest(range(len(c))) AS pos, unnest(c) AS char, c FROM ch),
 n AS (SELECT item_id, pos::INTEGER AS pos, char, CASE WHEN pos >= 1 THEN c[pos] ELSE '<START>' END AS p1, CASE WHEN pos >= 2 THEN c[pos - 1] ELSE '<START>' END AS p2,
   coalesce(c[pos + 2], '<END>') AS n1, coalesce(c[pos + 3], '<END>') AS n2, array_to_string(c[greatest(pos - 5, 0) + 1:pos + 6], '') AS w FROM e)
SELECT item_id, pos, char, lower(char) AS char_lower, p1 AS char_prev_1, p2 AS char_prev_2, n1 AS char_next_1, n2 AS char_next_2, p1 || char AS bigram_left, char || n1 AS bigram_right, p1 || char || n1 AS trigram,
 {_flag('char', r'\s')} AS is_whitespace, contains({_PUNCT}, char) AS is_punctuation, {_flag('char', r'\p{Nd}')} AS is_digit, {_flag('char', r'\p{L}')} AS is_letter, {_flag('char', r'\p{Lu}')} AS is_upper,
 {_flag('p1', r'\s')} AS prev_is_whitespace, {_flag('n1', r'\s')} AS next_is_whitespace, p1 <> '<START>' AND contains({_PUNCT}, p1) AS prev_is_punctuation, n1 <> '<END>' AND contains({_PUNCT}, n1) AS next_is_punctuation,
 {_flag('n1', r'\p{Lu}')} AS next_is_upper, {_flag('n1', r'\p{L}')} AS next_is_letter, regexp_matches(w, 'https?://') AS in_url_pattern, regexp_matches(w, '@.*\.') AS in_email_pattern,
 starts_with(w, '#') OR p1 = '#' AS in_hashtag_pattern, char = '''' AND {_flag('n1', r'\p{L}')} AS apostrophe_pattern, {_flag('p1', r'\p{Nd}')} AND {_flag('n1', r'\p{Nd}')} AS surrounded_by_digits FROM n"""


def _scores(distinct: bool) -> str:
    size = "len(list_distinct({}))" if distinct else "len({})"
    return f"""p AS ({_tok()}), g AS ({_rule_tokens('documents', 'doc_id', True)}),
 h AS (SELECT doc_id, p.w = g.w AS exact, len(list_distinct(list_intersect(p.w, g.w)))::DOUBLE AS hits, {size.format('p.w')} AS np, {size.format('g.w')} AS ng FROM p JOIN g USING (doc_id)),
 pr AS (SELECT doc_id, exact, CASE WHEN np > 0 THEN hits / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN hits / ng ELSE 0 END AS recall FROM h),
 sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


_MACRO = "SELECT count(*) AS n, avg(exact::INT) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum((NOT exact)::INT)::BIGINT AS errors FROM sc"
_CASES = values(samples.CASES, "token")

SQL: dict[str, str] = {
    "corpus_tokens": _exploded(_tok(), "doc_id"),
    "term_frequency": f"WITH {_TERMS} SELECT doc_id, word, cnt, round(tf, 9) AS tf FROM tf",
    "document_frequency": f"WITH {_TERMS} SELECT word, df FROM freq",
    "streaming_df": f"WITH {_TERMS} SELECT word, df FROM freq",
    "idf": f"WITH {_TERMS} SELECT word, round(idf, 9) AS idf FROM freq",
    "avg_tf": f"WITH {_TERMS} SELECT word, round(avg_tf, 9) AS avg_tf FROM freq",
    "avg_tfidf": f"WITH {_TERMS} SELECT word, round(avg_tfidf, 9) AS avg_tfidf FROM freq",
    "tfidf": f"WITH {_TERMS} SELECT doc_id, word, round(tf, 9) AS tf, round(idf, 9) AS idf, round(tf * idf, 9) AS tfidf FROM tf JOIN freq USING (word)",
    "stopwords_by_idf": f"WITH {_TERMS} SELECT word, round(idf, 9) AS idf FROM freq WHERE idf < 5.65",
    "stopwords_by_df": f"WITH {_TERMS} SELECT word, round(df_share, 9) AS df_share FROM freq WHERE df_share > 0.15",
    "stopwords_by_tf": f"WITH {_TERMS} SELECT word, round(avg_tf, 9) AS avg_tf FROM freq WHERE avg_tf < 0.01",
    "stopwords_by_tfidf": f"WITH {_TERMS} SELECT word, round(avg_tfidf, 9) AS avg_tfidf FROM freq WHERE avg_tfidf < 0.20",
    "stopwords_combined": f"WITH {_TERMS} SELECT word FROM freq WHERE idf < 5.65 AND df_share > 0.15",
    "idf_extremes": f"WITH {_TERMS} SELECT word, df, round(idf, 9) AS idf, round(df_share * 100, 6) AS pct FROM freq ORDER BY freq.idf, word LIMIT 50",
    "idf_highest": f"WITH {_TERMS} SELECT word, df, round(idf, 9) AS idf, round(df_share * 100, 6) AS pct FROM freq ORDER BY freq.idf DESC, word LIMIT 50",
    "stopword_filter": f"WITH {_STOP}, e AS ({_exploded(_tok(), 'doc_id')}), k AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS f FROM e WHERE token NOT IN (SELECT word FROM stop) GROUP BY doc_id) SELECT documents.doc_id, coalesce(f, '') AS filtered FROM documents LEFT JOIN k USING (doc_id)",
    "stopword_filter_join": f"WITH {_STOP}, e AS ({_exploded(_tok(), 'doc_id')}) SELECT doc_id, pos, token FROM e WHERE token NOT IN (SELECT word FROM stop)",
    "stopword_service": f"""WITH {_STOP}, e AS ({_exploded(_rule_tokens('documents', 'doc_id', True), 'doc_id')}), a AS (SELECT doc_id, pos, token, lower(token) IN (SELECT word FROM stop) AS hit FROM e WHERE regexp_full_match(token, '\\p{{L}}+')),
 f AS (SELECT doc_id, token, min(pos) AS pos FROM a WHERE NOT hit GROUP BY doc_id, token), u AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS unique_filtered FROM f GROUP BY doc_id),
 g AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) FILTER (NOT hit) AS filtered, string_agg(token, ' ' ORDER BY pos) FILTER (hit) AS removed, count(*) AS n, count(*) FILTER (NOT hit) AS k, count(*) FILTER (hit) AS r FROM a GROUP BY doc_id)
SELECT documents.doc_id, coalesce(filtered, '') AS filtered, coalesce(unique_filtered, '') AS unique_filtered, coalesce(removed, '') AS removed, coalesce(n, 0)::INT AS original_count, coalesce(k, 0)::INT AS filtered_count, coalesce(r, 0)::INT AS removed_count
FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN u USING (doc_id)""",
    "stopword_evaluation": f"""WITH {_STOP}, k AS (SELECT doc_id, word, word IN (SELECT word FROM stop) AS hit FROM tok), a AS (SELECT count(*) AS tb, count(*) FILTER (NOT hit) AS ta, count(*) FILTER (hit) AS st, count(DISTINCT word) AS vb, count(DISTINCT word) FILTER (NOT hit) AS va FROM k)
SELECT tb::BIGINT AS tokens_before, ta::BIGINT AS tokens_after, round(tb::DOUBLE / nd, 6) AS avg_before, round(ta::DOUBLE / nd, 6) AS avg_after, st::BIGINT AS stop_tokens, round(st * 100.0::DOUBLE / tb, 6) AS coverage_pct, vb AS vocab_before, va AS vocab_after,
 round((tb - ta) * 100.0::DOUBLE / tb, 6) AS token_reduction_pct, round((vb - va) * 100.0::DOUBLE / vb, 6) AS vocab_reduction_pct FROM a, nd""",
    "list_difference": f"WITH {_TERMS} SELECT count(*) AS n FROM freq WHERE idf < 5.65 AND NOT df_share > 0.15",
    "tr_lower": f"WITH {_WORDS} SELECT token, {_lower('token')} AS lowered FROM words",
    "tr_upper": f"WITH {_WORDS} SELECT token, {_upper('token')} AS uppered FROM words",
    "tr_capitalize": f"WITH {_WORDS} SELECT token, {_cap('token')} AS capitalized FROM words",
    "case_predicates": f"WITH {_WORDS} SELECT token, token = {_lower('token')} AS lower, token = {_upper('token')} AS upper, {_proper('token')} AS proper FROM words",
    "case_samples": f"SELECT token, {_transform('token')} AS transformed, {_proper('token')} AS proper, CASE WHEN upper(token) <> lower(token) AND token = upper(token) THEN 'KÂĞIT' WHEN len(token) > 1 AND {_head('token')} = upper({_head('token')}) AND {_head('token')} <> lower({_head('token')}) THEN 'Kâğıt' ELSE 'kâğıt' END AS matched FROM {_CASES}",
    "case_transform": f"WITH {_WORDS} SELECT token, {_transform('token')} AS transformed FROM words",
    "tokenize_clean": _exploded(_rule_tokens("documents", "doc_id", True), "doc_id"),
    "tokenize_rule": _exploded(_rule_tokens("benchmark", "item_id", False), "item_id"),
    "tokenize_unique": f"WITH e AS ({_exploded(_rule_tokens('benchmark', 'item_id', False), 'item_id')}), f AS (SELECT item_id, token, min(pos) AS p FROM e GROUP BY item_id, token) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY p) - 1)::INT AS pos, token FROM f",
    "service_tokenize": f"""WITH w AS ({_rule_tokens('conversations', 'conv_id, turn', False)}), e AS (SELECT conv_id, turn, unnest(range(len(w))) AS p, unnest(w) AS t FROM w), f AS (SELECT conv_id, turn, t, min(p) AS p FROM e GROUP BY ALL),
 u AS (SELECT conv_id, turn, string_agg(t, '␟' ORDER BY p) AS unique_tokens FROM f GROUP BY ALL)
SELECT w.conv_id, w.turn, array_to_string(w, '␟') AS tokens, coalesce(unique_tokens, '') AS unique_tokens FROM w LEFT JOIN u ON w.conv_id = u.conv_id AND w.turn = u.turn""",
    "entities": f"SELECT doc_id, len(regexp_extract_all(text, '{rules.URL}'))::INT AS urls, len(regexp_extract_all(text, '{rules.EMAIL}'))::INT AS emails, len(regexp_extract_all(text, '{rules.HASHTAG}'))::INT AS hashtags, len(regexp_extract_all(text, '{rules.MENTION}'))::INT AS mentions FROM documents",
    "abbrev_tokens": f"WITH {_WORDS}, ab AS (SELECT * FROM {values(samples.ABBREV, 'abbr, full_form')}) SELECT token, coalesce(full_form, token) AS expanded FROM words LEFT JOIN ab ON lower(token) = abbr",
    "abbrev_text": rf"""WITH ab AS (SELECT * FROM {values(samples.ABBREV, 'abbr, full_form')}), s AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS w FROM documents), e AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM s)
SELECT doc_id, string_agg(CASE WHEN full_form IS NOT NULL AND regexp_full_match(t, '\p{{L}}+') THEN full_form ELSE t END, '' ORDER BY p) AS expanded FROM e LEFT JOIN ab ON lower(t) = abbr GROUP BY doc_id""",
    **{f"accent_{n}": f"WITH src AS (SELECT * FROM {values(samples.COLLOQUIAL, 'token')}), {_accent_runs(_ORDER if n == 'full' else [n])}" for n in ("full", *rules.ACCENT)},
    "diacritics": f"""WITH {_LEX}, {_FIXES}, src AS (SELECT DISTINCT {_FOLD.format('word')} AS token FROM lex),
 best AS (SELECT {_FOLD.format('word')} AS f, word, row_number() OVER (PARTITION BY {_FOLD.format('word')} ORDER BY {_TR.format('word')} DESC, translate(word, 'sşcçgğuüoöiıî', '0101010101012')) AS k FROM lex)
SELECT token, CASE WHEN len(token) <= 1 THEN token WHEN right_form IS NOT NULL THEN lower(replace(right_form, 'İ', 'i̇')) WHEN l.word IS NOT NULL THEN token ELSE coalesce(best.word, token) END AS restored
FROM src LEFT JOIN fix ON wrong = token LEFT JOIN lex l ON l.word = token LEFT JOIN best ON f = token AND k = 1""",
    "diacritic_scores": f"WITH {_LEX} SELECT word, (CASE WHEN len(word) > 3 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(word, '(yor|miş|muş|mış)$') THEN 2 ELSE 0 END + 0.5 * ({_TR.format('word')}))::DOUBLE AS score FROM lex",
    "corrections": f"""WITH {_WORDS}, {_FIXES}
SELECT token, CASE WHEN right_form IS NULL THEN token WHEN token = upper(token) AND token <> lower(token) THEN upper(right_form)
 WHEN len(token) > 1 AND {_head('token')} = upper({_head('token')}) AND {_head('token')} <> lower({_head('token')}) THEN upper({_head('right_form')}) || lower(substr(right_form, 2))
 ELSE lower(replace(right_form, 'İ', 'i̇')) END AS corrected FROM words LEFT JOIN fix ON lower(token) = wrong""",
    "segments": f"WITH {_LEX} SELECT word, array_to_string(regexp_extract_all(word, '^[aeıioöuü]+|[^aeıioöuü][aeıioöuü]*'), '-') AS segments FROM lex",
    "vowels": f"""WITH {_LEX}, sk AS (SELECT word, {_SKEL.format('word')} AS s FROM lex), src AS (SELECT DISTINCT s AS token FROM sk WHERE s <> ''),
 c AS (SELECT token, word, len(word) - len(token) AS n FROM src JOIN sk ON s = token WHERE token NOT IN (SELECT word FROM lex) AND regexp_full_match(word, '([^aeıioöuü][aeıioöuü]?)*[^aeıioöuü]')),
 r AS (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY n, word) AS k FROM c)
SELECT token, coalesce(word, token) AS restored, (len(coalesce(word, token)) - len(token))::INT AS added FROM src LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (token)""",
    "suffix_statistics": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY len(suffix) DESC, suffix) AS k FROM {values(samples.SUFFIXES, 'suffix, category')})
SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s), 6) AS percentage, string_agg(suffix, ',' ORDER BY k) FILTER (k <= 5) AS examples FROM s GROUP BY category""",
    "sentences_clean": f"WITH {_SENTENCES} SELECT doc_id, sent_no, sentence FROM numbered",
    "service_sentences": f"WITH {_SENTENCES} SELECT doc_id, count(*)::INT AS sentence_count, string_agg((sent_no + 1)::VARCHAR || '. ' || sentence, chr(10) ORDER BY sent_no) AS shown FROM numbered GROUP BY doc_id",
    "nb_features": f"WITH {_NB}",
    "char_features": f"WITH {_CHARS}",
    "token_scores": f"WITH {_scores(False)} SELECT doc_id, exact, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sc",
    "token_scores_set": f"WITH {_scores(True)} SELECT doc_id, exact, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sc",
    "token_macro": f"WITH {_scores(False)}, m AS ({_MACRO}) SELECT n, errors, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "token_compare": f"""WITH a AS (SELECT * FROM (WITH {_scores(False)} {_MACRO})), b AS (SELECT * FROM (WITH {_scores(True)} {_MACRO})),
 m AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, a.{k} AS x, b.{k} AS y FROM a, b" for k in ("accuracy", "precision", "recall", "f1"))})
SELECT metric, round(x, 6) AS first, round(y, 6) AS second, CASE WHEN x > y THEN 'list' WHEN x < y THEN 'set' ELSE 'Tie' END AS winner FROM m""",
    "token_report": f"""WITH {_scores(False)}, m AS ({_MACRO}) SELECT unnest(range(6))::INT AS line_no, unnest(['Samples: ' || n, 'Errors: ' || errors, 'Accuracy: ' || printf('%.4f', accuracy), 'Precision: ' || printf('%.4f', precision),
 'Recall: ' || printf('%.4f', recall), 'F1: ' || printf('%.4f', f1)]) AS line FROM m""",
    "token_errors": f"WITH {_scores(False)} SELECT doc_id, round(f1, 9) AS f1 FROM sc WHERE NOT exact ORDER BY doc_id LIMIT 20",
    "sql_functions": f"SELECT conv_id, turn, {_lower('text')} AS low, {_upper('text')} AS up, len(w)::INT AS n_tokens, {_FOLD.format('text')} AS folded FROM (SELECT *, list_filter(regexp_extract_all({_lower('text')}, '{_W}+'), lambda t: regexp_full_match(t, '[a-zçğıöşü]+')) AS w FROM conversations)",
}
_PARTS = {
    "tok": _tok, "rule_tokens": _rule_tokens, "fixes": _FIXES, "words": _WORDS, "sentences": _SENTENCES, "kind": _kind, "blank": _SPACES, "pieces": _PIECES,
    "fold": _FOLD, "turkish": _TR, "transform": _transform, "accent": _accent, "capital": _cap,
}
SQL |= search_oracle.queries(_PARTS)
SQL |= source_queries.queries_sql(_PARTS, SQL)
