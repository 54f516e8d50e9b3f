"""DuckDB SQL of the searches: stemming, spelling, normalisation in stages, naive Bayes, and the sources.

``parts`` gives the shared expressions of ``oracle.py``, which this module extends.
"""

from __future__ import annotations

from collections.abc import Callable

from sparkhece.functions import rules
from sparkhece.plans import samples
from sparkhece.plans.samples import values

_VOWEL = f"[{rules.VOWELS}]"
_SOFT = "CASE " + " ".join(f"WHEN {{0}} = '{a}' THEN '{b}'" for a, b in rules.DIACRITIC_PAIRS.items()) + " ELSE '' END"


# ---- stemmer -----------------------------------------------------------------------------

def stemmer(source: str, lexicon: str) -> str:
    """CTEs ``met`` (all forms, in the order of the search), ``valid`` (with scores) and ``short``; ``source`` gives ``w``, ``lexicon`` gives ``word``."""
    last, before, cut = "b[-1:]", "CASE WHEN len(b) > 1 THEN b[-2:-2] ELSE '' END", "b[:len(b) - 1]"
    hard = " ".join(f"WHEN {last} = '{x}' THEN {cut} || '{y}'" for x, y in (("b", "p"), ("c", "ç"), ("d", "t"), ("ğ", "k"), ("g", "k")))
    vowel = lambda x: f"regexp_full_match({x}, '{_VOWEL}')"
    cluster = f"{before} <> '' AND NOT {vowel(last)} AND NOT {vowel(before)}"
    forms = ["b", f"CASE {hard} END", *[f"CASE WHEN {cluster} THEN {cut} || '{v}' || {last} END" for v in "ıiuü"]]
    forms += [f"CASE WHEN {before} = {last} AND contains('kpçtfsşh', {last}) THEN {cut} END"]
    forms += [f"CASE WHEN len(b) > 2 AND ({last} = 'n' AND {vowel('suffix[:1]')} OR {last} = 'y' AND {vowel(before)}) THEN {cut} END"]
    forms += [f"CASE WHEN b[-2:] IN ('su', 'sü') THEN {cut} || '{x}' END" for x in ("yu", "yü")]
    a, b = f"regexp_extract(f[:len(f) - len(suffix)], '({_VOWEL})[^{rules.VOWELS}]*$', 1)", f"regexp_extract(suffix, '{_VOWEL}')"
    harmony = f"({a} = '' OR {b} = '' OR contains('aıou', {a}) = contains('aıou', {b}))"
    return f"""sx AS (SELECT suffix, category, row_number() OVER (ORDER BY len(suffix) DESC, suffix) AS so, CASE category WHEN 'FUNCTIONAL' THEN 3 WHEN 'DERIVATIONAL' THEN -1 ELSE 1 END AS own FROM {values(samples.SUFFIXES, 'suffix, category')}),
 lx AS (SELECT DISTINCT word FROM ({lexicon})),
 met(w, f, lvl, ord, removed, kinds, own) USING KEY (w, f) AS (
  SELECT DISTINCT w, w AS f, 0 AS lvl, 0::BIGINT AS ord, '' AS removed, '' AS kinds, 0::BIGINT AS own FROM ({source})
  UNION
  SELECT w, f, lvl, ord, removed, kinds, own FROM (
   SELECT *, row_number() OVER (PARTITION BY w, f ORDER BY ord) AS k FROM (
    SELECT w, v AS f, lvl + 1 AS lvl, row_number() OVER (PARTITION BY w ORDER BY ord, so, vi) AS ord, removed, kinds, own FROM (
     SELECT w, lvl, ord, so, removed || CASE WHEN removed = '' THEN '' ELSE '+' END || suffix AS removed, kinds || CASE WHEN kinds = '' THEN '' ELSE '+' END || category AS kinds, own,
      unnest(range({len(forms)})) AS vi, unnest([{', '.join(forms)}]) AS v
     FROM (SELECT m.w, m.lvl, m.ord, m.removed, m.kinds, m.own + sx.own AS own, so, suffix, category, f[:len(f) - len(suffix)] AS b FROM met m JOIN sx ON ends_with(f, suffix) WHERE lvl < 10 AND len(f) - len(suffix) >= 2 AND {harmony}))
    WHERE v IS NOT NULL AND len(v) >= 2)) c
  WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM recurring.met q WHERE q.w = c.w AND q.f = c.f)),
 valid AS (SELECT w, f, removed, kinds, 120 - 5 * abs(len(f) - 5) + own - CASE WHEN len(f) < 3 THEN 50 ELSE 0 END AS tenths, lvl, ord FROM met WHERE lvl < 10 AND len(f) >= 2 AND f IN (SELECT word FROM lx)),
 best AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tenths DESC, lvl, ord) AS k, count(*) OVER (PARTITION BY w) AS n FROM valid),
 short AS (SELECT w, f, row_number() OVER (PARTITION BY w ORDER BY len(f), f) AS k, count(*) FILTER (lvl < 10) OVER (PARTITION BY w) AS examined FROM met)"""


_STEM = "CASE WHEN best.f IS NOT NULL THEN best.f WHEN len(short.f) < len(short.w) THEN short.f ELSE short.w END"
_FOUND = "short LEFT JOIN best ON best.w = short.w AND best.k = 1 WHERE short.k = 1"


# ---- spelling ----------------------------------------------------------------------------

def edits(w: str) -> str:
    """All strings one edit from ``w`` with their costs, in order: deletions, insertions, substitutions, transpositions."""
    at, letters = f"range(1, len({w}) + 1)", f"string_split('{rules.ALPHABET}', '')"
    one = lambda c, p="1.0": f"{{'c': {c}, 'p': ({p})::DOUBLE}}"
    swap = one(f"{w}[:i - 1] || {w}[i + 1:i + 1] || {w}[i:i] || {w}[i + 2:]")
    return (
        f"list_concat(list_transform({at}, lambda i: {one(f'{w}[:i - 1] || {w}[i + 1:]')}), "
        f"flatten(list_transform(range(0, len({w}) + 1), lambda i: list_transform({letters}, lambda a: {one(f'CASE WHEN i = 0 THEN a || {w} ELSE {w}[:i] || a || {w}[i + 1:] END')}))), "
        f"flatten(list_transform({at}, lambda i: list_transform(list_filter({letters}, lambda a: a <> {w}[i:i]), lambda a: {one(f'{w}[:i - 1] || a || {w}[i + 1:]', f'CASE WHEN a = {_SOFT.format(f'{w}[i:i]')} THEN 0.3 ELSE 1.0 END')}))), "
        f"list_transform(range(1, len({w})), lambda i: {swap}))"
    ).replace("[:i - 1]", "[1:i - 1]").replace("[:i]", "[1:i]")


def spelling(source: str, lexicon: str, distance: int, name: str = "sp") -> str:
    """CTEs up to ``name_done (token, corrected)`` of the words that the lexicon lacks; ``lexicon`` names a table ``(word, freq)``."""
    steps = [
        f"{name}_p AS MATERIALIZED (SELECT word, sum(freq)::DOUBLE / sum(sum(freq)) OVER () AS prob FROM {lexicon} GROUP BY word)",
        f"{name}_w AS MATERIALIZED (SELECT DISTINCT token FROM ({source}) WHERE token <> '' AND token NOT IN (SELECT word FROM {name}_p))",
        f"{name}_1 AS MATERIALIZED (SELECT token, k, e.c AS c, e.p AS p FROM (SELECT token, unnest(range(len(l))) AS k, unnest(l) AS e FROM (SELECT token, {edits('token')} AS l FROM {name}_w)))",
        f"{name}_a AS MATERIALIZED (SELECT token, c, 1 AS far, min(k) AS k1, 0 AS k2, arg_min(p, k) AS cost FROM {name}_1 JOIN {name}_p ON c = word GROUP BY token, c)",
    ]
    both = f"SELECT * FROM {name}_a"
    if distance > 1:
        steps += [
            f"{name}_2 AS (SELECT token, k1, k2, e.c AS c, p + e.p AS p FROM (SELECT token, k AS k1, p, unnest(range(len(l))) AS k2, unnest(l) AS e FROM (SELECT token, k, p, {edits('c')} AS l FROM {name}_1)))",
            f"{name}_b AS MATERIALIZED (SELECT token, c, 2 AS far, min(k1 * 100000 + k2) AS k1, 0 AS k2, arg_min(p, k1 * 100000 + k2) AS cost FROM {name}_2 JOIN {name}_p ON c = word GROUP BY token, c)",
        ]
        both += f" UNION ALL SELECT * FROM {name}_b WHERE (token, c) NOT IN (SELECT token, c FROM {name}_a)"
    steps += [
        f"{name}_r AS (SELECT token, c, row_number() OVER (PARTITION BY token ORDER BY prob / (1 + cost) DESC, far, k1) AS k FROM ({both}) x JOIN {name}_p ON c = word)",
        f"{name}_done AS MATERIALIZED (SELECT token, c AS corrected FROM {name}_r WHERE k = 1)",
    ]
    return ", ".join(steps)


# ---- normalisation -----------------------------------------------------------------------

def match_case(right: str, token: str) -> str:
    head = f"{token}[1:1]"
    return (
        f"CASE WHEN {token} = upper({token}) AND {token} <> lower({token}) THEN upper({right}) WHEN len({token}) > 1 AND {head} = upper({head}) AND {head} <> lower({head}) "
        f"THEN upper({right}[1:1]) || lower({right}[2:]) ELSE lower(replace({right}, 'İ', 'i̇')) END"
    )


class Stages:
    """A chain of CTEs ``(v, n)``: every stage maps the form ``n`` of the word ``v``. ``lexicon`` names a table ``(word, freq)`` of lower-cased words."""

    def __init__(self, name: str, source: str, lexicon: str, fold: str, turkish: str, transform: Callable[[str], str], accent: Callable[[str, list[str]], str]):
        self.name, self.lexicon, self.fold, self.turkish, self.transform, self.accent_rules = name, lexicon, fold, turkish, transform, accent
        self.steps, self.at = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT v, v AS n FROM ({source}))"], 0

    def add(self, body: str) -> None:
        self.at += 1
        self.steps.append(f"{self.name}{self.at} AS MATERIALIZED ({body.replace('@', f'{self.name}{self.at - 1}')})")

    def abbreviation(self) -> None:
        self.add("SELECT v, coalesce(full_form, n) AS n FROM @ LEFT JOIN ab ON lower(n) = abbr")

    def case(self) -> None:
        self.add(f"SELECT v, {self.transform('n')} AS n FROM @")

    def diacritics(self) -> None:
        o, b = "n[i:i]", "best.word[i:i]"
        letters = f"CASE WHEN {o} = upper({o}) AND {o} <> lower({o}) THEN upper({b}) WHEN {b} = {self.fold.format(f'lower({o})')} THEN {o} ELSE {b} END"
        cased = f"array_to_string(list_transform(range(1, len(best.word) + 1), lambda i: {letters}), '')"
        ranked = f"SELECT {self.fold.format('word')} AS f, word, row_number() OVER (PARTITION BY {self.fold.format('word')} ORDER BY {self.turkish.format('word')} DESC, translate(word, 'sşcçgğuüoöiıî', '0101010101012')) AS k FROM (SELECT DISTINCT word FROM {self.lexicon})"
        self.add(
            f"SELECT v, CASE WHEN regexp_matches(n, '[{rules.TURKISH}]') OR len(n) <= 1 THEN n WHEN right_form IS NOT NULL THEN {match_case('right_form', 'n')} WHEN l.word IS NOT NULL THEN n WHEN best.word IS NOT NULL THEN {cased} ELSE n END AS n "
            f"FROM @ LEFT JOIN fix ON wrong = lower(n) LEFT JOIN (SELECT DISTINCT word FROM {self.lexicon}) l ON l.word = lower(n) LEFT JOIN ({ranked}) best ON f = lower(n) AND k = 1"
        )

    def vowels(self) -> None:
        skeleton = f"regexp_replace({{}}, '{_VOWEL}', '', 'g')"
        own = lambda x: f"len(regexp_replace({x}, '[^{rules.VOWELS}]', '', 'g'))"
        pattern = rf"'\Q' || w[1:1] || '\E' || regexp_replace(w[2:], '([^{rules.VOWELS}])', '{_VOWEL}?\\Q\1\\E', 'g')"
        self.add(
            f"WITH o AS (SELECT DISTINCT n AS t, lower(n) AS w FROM @ WHERE lower(n) NOT IN (SELECT word FROM {self.lexicon}) AND n <> ''), "
            f"c AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY {own('word')} - {own('w')}, word) AS k FROM o JOIN (SELECT DISTINCT word FROM {self.lexicon}) l ON {skeleton.format('word')} = {skeleton.format('w')} "
            f"WHERE NOT (regexp_full_match(w[1:1], '{_VOWEL}') AND {skeleton.format('w')} <> '') AND regexp_full_match(word, {pattern})) "
            "SELECT v, coalesce(word, n) AS n FROM @ LEFT JOIN c ON t = n AND k = 1"
        )

    def spelling(self) -> None:
        name = f"{self.name}{self.at}s"
        self.steps.append(spelling(f"SELECT n AS token FROM {self.name}{self.at}", self.lexicon, 2, name))
        self.add(f"SELECT v, coalesce(corrected, n) AS n FROM @ LEFT JOIN {name}_done ON token = n")

    def accent(self) -> None:
        """Rules see runs of word characters; what stands between them stays."""
        runs = rf"regexp_extract_all(n, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
        self.add(f"SELECT v, n, unnest(range(len(w))) AS p, unnest(w) AS x FROM (SELECT v, n, {runs} AS w FROM @)")
        for name in ("negative", "future", "present", "question", "other"):
            self.add(f"SELECT v, n, p, {self.accent_rules('x', [name])} AS x FROM @")
        self.add("SELECT v, string_agg(x, '' ORDER BY p) AS n FROM @ GROUP BY v")


MODULES = ("abbreviation", "case", "diacritics", "vowels", "spelling", "accent")


def normalized(name: str, source: str, lexicon: str, parts: dict, disabled: tuple[str, ...] = (), abbrev: bool = False) -> tuple[str, str]:
    """CTEs of the whole chain, and the name of the last one."""
    s = Stages(name, source, lexicon, parts["fold"], parts["turkish"], parts["transform"], parts["accent"])
    for module in MODULES:
        if module not in disabled and (module != "abbreviation" or abbrev):
            getattr(s, module)()
    return ", ".join(s.steps), f"{name}{s.at}"


# ---- naive Bayes -------------------------------------------------------------------------

def mark_features(marks: str, keys: str, kind: Callable[[str, bool], str]) -> str:
    """Feature rows ``(keys, i, feature)`` of the marks ``(keys, t, c, i)``; ``c`` are the characters of ``t``."""
    return rf"""SELECT {keys}, i, feature FROM (SELECT {keys}, i, unnest([
   'curr_char=' || m, 'next_char=' || CASE WHEN nx IS NULL THEN 'END' ELSE {kind('nx', True)} END,
   CASE WHEN regexp_full_match(nx, '\s') AND n2 IS NOT NULL THEN 'after_space=' || CASE WHEN {kind('n2', True)} IN ('UPPER', 'LOWER', 'DIGIT', 'PUNCT') THEN {kind('n2', True)} ELSE 'OTHER' END END,
   'prev_char=' || CASE WHEN pv IS NULL THEN 'START' ELSE {kind('pv', False)} END,
   'next_word_capital=' || CASE WHEN regexp_matches(r, '^\s*\p{{Lu}}') THEN 'True' ELSE 'False' END,
   CASE WHEN w <> '' THEN 'prev_word=' || CASE WHEN regexp_full_match(regexp_replace(w, '[,.]', '', 'g'), '\p{{Nd}}+') THEN 'NUMBER'
     WHEN len(w) <= 3 AND regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '\p{{Ll}}') THEN 'ABBREV'
     WHEN regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '\p{{Lu}}') THEN 'LOWER' WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'CAPITAL' ELSE 'OTHER' END END]) AS feature
  FROM (SELECT {keys}, i, c[i] AS m, c[i + 1] AS nx, c[i + 2] AS n2, CASE WHEN i > 1 THEN c[i - 1] END AS pv,
    regexp_extract(array_to_string(c[greatest(1, i - 300):i - 1], ''), '(\S+)\s*$', 1) AS w, array_to_string(c[i + 1:i + 100], '') AS r FROM ({marks}))) WHERE feature IS NOT NULL"""


_MARKS = "list_filter(range(1, len(c) + 1), lambda i: c[i] IN ('.', '!', '?'))"


def naive_bayes(sentences: str, kind: Callable[[str, bool], str]) -> str:
    """CTEs of the training on benchmark sentences (``numbered``), up to the weights."""
    return f"""{sentences},
 ln AS (SELECT item_id * 1000 + sent_no AS ex, trim(sentence) AS s, lead(trim(sentence)) OVER (PARTITION BY item_id ORDER BY sent_no) AS nxt FROM numbered),
 inn AS (SELECT ex, s AS t, string_split(s, '') AS c FROM ln), inm AS (SELECT ex, t, c, unnest({_MARKS}) AS i, list_max({_MARKS}) AS z FROM inn),
 exs AS (SELECT row_number() OVER () AS e, * FROM (SELECT CASE WHEN i = z THEN 'boundary' ELSE 'non_boundary' END AS class, t, c, i FROM inm
  UNION ALL SELECT 'boundary', t, string_split(t, ''), i FROM (SELECT unnest([s || nxt, s || ' ' || nxt]) AS t, len(s) AS i FROM ln WHERE nxt IS NOT NULL AND regexp_matches(s, '[.!?]$')))),
 nbf AS MATERIALIZED (SELECT class, feature, count(*) AS n FROM ({mark_features('SELECT e, class, t, c, i FROM exs', 'e, class', kind)}) GROUP BY class, feature),
 cls AS (SELECT coalesce(sum((class = 'boundary')::INT), 0) AS b, coalesce(sum((class <> 'boundary')::INT), 0) AS o, count(*) AS n FROM exs),
 tot AS (SELECT coalesce(sum(n) FILTER (class = 'boundary'), 0) AS b, coalesce(sum(n) FILTER (class <> 'boundary'), 0) AS o, count(DISTINCT feature) AS v FROM nbf),
 wts AS (SELECT feature, ln((coalesce(sum(nbf.n) FILTER (class = 'boundary'), 0) + 1)::DOUBLE / (tot.b + tot.v)) - ln((coalesce(sum(nbf.n) FILTER (class <> 'boundary'), 0) + 1)::DOUBLE / (tot.o + tot.v)) AS w FROM nbf, tot GROUP BY feature, tot.b, tot.o, tot.v),
 par AS (SELECT ln(1.0::DOUBLE / (tot.b + v)) - ln(1.0::DOUBLE / (tot.o + v)) AS unseen, CASE WHEN cls.b > 0 THEN ln(cls.b::DOUBLE / cls.n) ELSE -1000 END - CASE WHEN cls.o > 0 THEN ln(cls.o::DOUBLE / cls.n) ELSE -1000 END AS prior FROM tot, cls)"""


def bayes_sentences(training: str, kind: Callable[[str, bool], str], blank: str) -> str:
    """CTEs up to ``nbs (doc_id, sent_no, sentence)``: the documents cut behind boundary marks."""
    return f"""{training},
 dch AS (SELECT doc_id, text AS t, string_split(text, '') AS c FROM documents),
 dmk AS (SELECT doc_id, t, c, unnest({_MARKS}) AS i FROM dch),
 dsc AS (SELECT doc_id, i, sum(coalesce(w, unseen)) + any_value(prior) AS s FROM ({mark_features('SELECT * FROM dmk', 'doc_id', kind)}) f LEFT JOIN wts USING (feature), par GROUP BY doc_id, i),
 dct AS (SELECT doc_id, i FROM dsc WHERE round(s, 9) > 0 UNION SELECT doc_id, len(t) FROM dch),
 dsg AS (SELECT doc_id, i, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM dct),
 dst AS (SELECT doc_id, i, regexp_replace(t[a + 1:i], '^{blank}+|{blank}+$', '', 'g') AS sentence FROM dsg JOIN dch USING (doc_id)),
 nbs AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sent_no, sentence FROM dst WHERE sentence <> '')"""


# ---- the quote stack ---------------------------------------------------------------------

def stacked_sentences(clean: str, table: str, key: str) -> str:
    """CTEs up to ``qs (key, sent_no, sentence)``: the rule splitter with its quote stack, one event of every text a step.

    ``clean`` are the CTEs of the splitter without quotes, whose ``br`` says which marks end a sentence.
    """
    opened = " ".join(f"WHEN c = '{a}' THEN stack || '{b}'" for a, b in (('"', '"'), ("''", "''"), ("«", "»"), (",", " ")))
    after = "ltrim(array_to_string(c[i + 1:i + 8], ''))[1:1]"
    upper = r"""[\p{Lu}"''«,]"""
    return f"""{clean.replace('documents', table).replace('doc_id', key)},
 ev AS (SELECT {key}, list(e ORDER BY i) AS es FROM (SELECT {key}, i, {{'i': i, 'c': c[i], 'quiet': coalesce(cut, false),
   'behind': i > 1 AND c[i - 1] IN ('.', '!', '?') AND ({after} = '' OR regexp_full_match({after}, '{upper}'))}} AS e
   FROM (SELECT {key}, c, unnest(range(1, len(c) + 1)) AS i FROM ch) x LEFT JOIN br USING ({key}, i) WHERE c[i] IN ('"', '''', '«', '»', ',', ' ', '.', '!', '?')) GROUP BY {key}),
 walk AS (SELECT {key}, 0 AS k, '' AS stack, 0::BIGINT AS i, false AS cut FROM ev
  UNION ALL
  SELECT {key}, k + 1, CASE {opened} WHEN closes THEN stack[1:len(stack) - 1] ELSE stack END, i, CASE WHEN c IN ('"', '''', '«', ',') THEN false WHEN closes THEN behind ELSE c IN ('.', '!', '?') AND stack = '' AND quiet END
  FROM (SELECT {key}, k, stack, e.i AS i, e.c AS c, e.quiet AS quiet, e.behind AS behind, stack <> '' AND stack[-1:] = e.c AS closes FROM (SELECT r.{key}, k, stack, es[k + 1] AS e FROM walk r JOIN ev USING ({key}) WHERE k < len(es)) w)),
 qcut AS (SELECT {key}, i FROM walk WHERE cut UNION SELECT {key}, len(t) FROM flat WHERE len(t) > 0),
 qseg AS (SELECT {key}, i, lag(i, 1, 0) OVER (PARTITION BY {key} ORDER BY i) AS a FROM qcut),
 qsent AS (SELECT {key}, i, trim(t[a + 1:i]) AS sentence FROM qseg JOIN flat USING ({key})),
 qs AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INTEGER AS sent_no, sentence FROM qsent WHERE sentence <> '')"""


def queries(parts: dict) -> dict[str, str]:
    """``parts``: tok, rule_tokens, lex, fixes, words, sentences, kind, blank, fold, turkish, transform, accent."""
    tok, kind = parts["tok"], parts["kind"]
    lexicon = f"SELECT DISTINCT unnest(w) AS word FROM ({tok('benchmark', 'item_id')})"
    vocabulary = f"SELECT DISTINCT unnest(w) AS w FROM ({tok('documents', 'doc_id')})"
    stems = f"WITH RECURSIVE {stemmer(vocabulary, lexicon)}"
    pieces = f"pc AS (SELECT item_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM ({parts['rule_tokens']('benchmark', 'item_id', False)}))"
    bench = f"{parts['sentences'].replace('documents', 'benchmark').replace('doc_id', 'item_id')}"
    training = naive_bayes(bench, kind)
    split = f"WITH {bayes_sentences(training, kind, parts['blank'])}"
    words = lambda column: f"vx AS (SELECT word, 1 AS freq FROM (SELECT DISTINCT unnest(w) AS word FROM ({tok('documents', 'doc_id')})))"
    ab = f"ab AS (SELECT * FROM {values(samples.ABBREV, 'abbr, full_form')})"
    served, last = normalized("a", r"SELECT t AS v FROM pc WHERE regexp_matches(t, '\p{L}')", "vx", parts, ("spelling",), True)
    spaced = f"sq AS (SELECT item_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM (SELECT item_id, regexp_extract_all(text, '{parts['pieces']}') AS w FROM benchmark))"
    plain, end = normalized("a", r"SELECT t AS v FROM sq WHERE regexp_matches(t, '\p{L}')", "vx", parts, ("spelling", "vowels"))
    pairs, sx = f"pr AS (SELECT * FROM {values(samples.ACCURACY, 'input, expected')})", f"sx AS (SELECT * FROM {values(samples.LEXICON, 'word, freq')})"
    full, done = normalized("a", "SELECT input AS v FROM pr", "sx", parts)
    configs, outs = [], []
    for k, off in enumerate(("full", *MODULES, "proper")):
        steps, out = normalized(f"m{k}_", "SELECT input AS v FROM pr", "sx", parts, (off,))
        configs.append(steps)
        outs.append(f"SELECT '{off if off == 'full' else f'no_{off}'}' AS config, expected, n AS output FROM pr JOIN {out} ON v = input")
    rewritten, fixed = normalized("a", "SELECT t AS v FROM gp", "vx", parts, ("abbreviation", "case", "vowels", "spelling", "accent"))
    changed, standard = normalized("a", "SELECT token AS v FROM words", "vx", parts, ("abbreviation", "case", "diacritics", "vowels", "spelling"))
    lines = lambda t: f"SELECT unnest(range(len(l))) AS p, unnest(l) AS line FROM (SELECT string_split('{t.replace(chr(39), chr(39) * 2)}', chr(10)) AS l)"
    morph = f"""ml AS (SELECT p, line, starts_with(line, chr(9)) AS tab FROM ({lines(samples.MORPH)}) WHERE trim(line, ' ' || chr(9)) <> '' AND NOT starts_with(line, repeat('-', 50))),
 mg AS (SELECT *, sum((NOT tab)::INT) OVER (ORDER BY p) AS g FROM ml), mw AS (SELECT g, trim(line) AS word FROM mg WHERE NOT tab), ml2 AS (SELECT word, max(g) AS g FROM mw GROUP BY word),
 mp AS (SELECT 1::BIGINT AS doc_id, word, trim(line, ' ' || chr(9)) AS analysis FROM mg JOIN ml2 USING (g) WHERE tab)"""
    marked = " ".join(f"WHEN c = '{a}' THEN ['{a}', {', '.join(repr(x) for x in ('ıî' if a == 'i' else b))}]" for a, b in rules.DIACRITIC_PAIRS.items())
    variants = f"""RECURSIVE src AS (SELECT DISTINCT unnest(w) AS token FROM ({tok('benchmark', 'item_id')})),
 vr AS (SELECT token, 0 AS i, [''] AS forms FROM src
  UNION ALL SELECT token, i + 1, list_slice(flatten(list_transform(forms, lambda f: list_transform(o, lambda x: f || x))), 1, 200)
  FROM (SELECT token, i, forms, CASE {marked} ELSE [c] END AS o FROM (SELECT token, i, forms, token[i + 1:i + 1] AS c FROM vr WHERE i < len(token))))"""
    return {
        "diacritic_variants": f"WITH {variants} SELECT token, unnest(range(len(forms)))::INT AS pos, unnest(forms) AS variant FROM vr WHERE i = len(token)",
        "windowed_df": f"SELECT doc_id // 24 AS day, word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM ({tok('documents', 'doc_id')})) GROUP BY ALL",
        "stems": f"{stems} SELECT short.w AS token, {_STEM} AS stem FROM {_FOUND}",
        "stem_details": f"{stems} SELECT short.w AS word, coalesce(best.f, short.f) AS stem, coalesce(removed, '') AS removed, coalesce(kinds, '') AS categories, coalesce(tenths / 10.0, 0)::DOUBLE AS score, best.f IS NOT NULL OR short.f IN (SELECT word FROM lx) AS valid, greatest(0, least(3, coalesce(n, 0)) - 1)::INT AS alternatives, examined::INT AS total_paths_explored FROM {_FOUND}",
        "service_stem": rf"WITH RECURSIVE {pieces}, {stemmer(r'''SELECT lower(t) AS w FROM pc WHERE regexp_full_match(t, '\p{L}+')''', lexicon)} SELECT item_id, string_agg(CASE WHEN short.w IS NULL THEN t ELSE t || ' → ' || {_STEM} END, '␟' ORDER BY p) AS results FROM pc LEFT JOIN short ON short.w = lower(t) AND short.k = 1 AND regexp_full_match(t, '\p{{L}}+') LEFT JOIN best ON best.w = short.w AND best.k = 1 GROUP BY item_id",
        "spelling": f"WITH src AS (SELECT * FROM {values(samples.MISSPELLED, 'token')}), {sx}, {spelling('SELECT token FROM src', 'sx', 2)} SELECT src.token, coalesce(corrected, src.token) AS corrected FROM src LEFT JOIN sp_done USING (token)",
        "spelling_goldens": f"WITH src AS (SELECT * FROM {values(samples.SPELLING, 'token, expected')}), gx AS (SELECT expected AS word, count(*) AS freq FROM src GROUP BY expected), {spelling('SELECT token FROM src', 'gx', 2)} SELECT src.token, expected, coalesce(corrected, src.token) AS corrected, CASE WHEN coalesce(corrected, src.token) = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM src LEFT JOIN sp_done USING (token)",
        "attempts": f"SELECT token, output, CASE WHEN output IS NULL THEN 'ERROR' WHEN output = token[1:1] THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT token, nullif(regexp_extract(token, '{_VOWEL}'), '') AS output FROM (SELECT DISTINCT unnest(w) AS token FROM ({tok('benchmark', 'item_id')})))",
        "spelling_corpus": f"WITH fx AS (SELECT word, count(*) AS freq FROM (SELECT unnest(w) AS word FROM ({tok('documents', 'doc_id')})) GROUP BY word), src AS (SELECT DISTINCT unnest(w) AS token FROM ({tok('conversations', 'conv_id')})), {spelling('SELECT token FROM src', 'fx', 1)} SELECT src.token, coalesce(corrected, src.token) AS corrected FROM src LEFT JOIN sp_done USING (token)",
        "sql_sentences": f"WITH RECURSIVE {stacked_sentences(parts['sentences'], 'benchmark', 'item_id')} SELECT item_id, sent_no, sentence FROM qs",
        "nb_model": f"WITH {training} SELECT class, feature, n FROM nbf",
        "sentences_nb": f"{split} SELECT doc_id, sent_no, sentence FROM nbs",
        "service_sentences_nb": f"{split} SELECT d.doc_id, count(s.doc_id)::INT AS sentence_count, coalesce(string_agg(sentence, '␟' ORDER BY sent_no), '') AS sentences FROM documents d LEFT JOIN nbs s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
        "service_normalize": f"WITH {pieces}, {words('word')}, {parts['fixes']}, {ab}, {served} SELECT item_id, string_agg(CASE WHEN v IS NULL THEN t ELSE t || ' → ' || n END, '␟' ORDER BY p) AS results FROM pc LEFT JOIN {last} ON v = t GROUP BY item_id",
        "normalize_sequences": f"WITH {spaced}, {words('word')}, {parts['fixes']}, {plain} SELECT item_id AS doc_id, string_agg(coalesce(n, t), '␟' ORDER BY p) AS normalized FROM sq LEFT JOIN {end} ON v = t GROUP BY item_id",
        "normalize_text": f"WITH {spaced}, {words('word')}, {parts['fixes']}, {plain} SELECT item_id, string_agg(coalesce(n, t), ' ' ORDER BY p) AS normalized FROM sq LEFT JOIN {end} ON v = t GROUP BY item_id",
        "normalize_status": f"WITH {pairs}, {sx}, {parts['fixes']}, {full} SELECT input, n AS output, expected, CASE WHEN trim(n) = trim(expected) THEN 'PASS' ELSE 'FAIL' END AS status FROM pr JOIN {done} ON v = input",
        "normalize_accuracy": f"WITH {pairs}, {sx}, {parts['fixes']}, {full}, r AS (SELECT count(*) AS total, sum((trim(n) = trim(expected))::INT)::BIGINT AS passed FROM pr JOIN {done} ON v = input) SELECT total, passed, 0::BIGINT AS errors, passed * 100.0::DOUBLE / total AS accuracy_pct, passed * 100.0::DOUBLE / total > 80 AS ok FROM r",
        "ablation": f"WITH {pairs}, {sx}, {parts['fixes']}, {', '.join(configs)}, o AS ({' UNION ALL '.join(outs)}), a AS (SELECT config, avg((trim(output) = trim(expected))::INT::DOUBLE) * 100 AS acc FROM o GROUP BY config), d AS (SELECT config, acc, acc - (SELECT acc FROM a WHERE config = 'full') AS impact FROM a) SELECT config, acc AS accuracy_pct, impact, CASE WHEN impact < -5 THEN 'CRITICAL' WHEN impact < -2 THEN 'HIGH' WHEN impact < -0.5 THEN 'MEDIUM' ELSE 'LOW' END AS importance FROM d",
        "accent_words": f"WITH {parts['words']}, {words('word')}, {changed} SELECT v AS token, n AS standard FROM {standard}",
        "diacritics_text": rf"WITH gp AS (SELECT item_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS w FROM benchmark)), {words('word')}, {parts['fixes']}, {rewritten} SELECT item_id, string_agg(n, '' ORDER BY p) AS corrected FROM gp JOIN {fixed} ON v = t GROUP BY item_id",
        "morph_parse": f"WITH {morph} SELECT doc_id, word, analysis FROM mp",
        "proper_nouns": f"WITH {morph}, tk AS (SELECT * FROM {values([('Ali', 'ali'), ('okudu', 'okudu'), ('kitabı', 'kitabı')], 'token, normalized')}) SELECT token, CASE WHEN token IN (SELECT word FROM mp WHERE contains(analysis, '[Prop]')) THEN {parts['capital']('normalized')} ELSE normalized END AS normalized FROM tk",
    }
