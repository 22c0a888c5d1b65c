"""The subpackage's queries as SQL for DuckDB, where SQL can express them on whole tables."""

from __future__ import annotations

import re

from marketpulse.llm import licenses, repetition

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_quote(pattern)})"


DECONTAMINATION = f"""WITH
d AS (SELECT doc_id, row_number() OVER () AS r, {_words(_lowered("text"), _PLAIN)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_lowered("text"), _PLAIN)} AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, size,
    unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS win FROM bs
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)
),
hits AS (SELECT r, size, i, item FROM places JOIN windows USING (size, win)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def _repetition() -> str:
    parts, joins, shares, over = [], [], [], []
    for n in sorted({*repetition.GRAM_LIMITS, repetition.BASE_GRAM}):
        parts.append(f"""g{n} AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c, row_number() OVER (PARTITION BY r, gram ORDER BY i) AS k
  FROM (SELECT r, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram
        FROM (SELECT r, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d))
),
c{n} AS (
  SELECT r, count(*) FILTER (twice) AS places, sum(len(d.w[p])) FILTER (again) AS chars
  FROM (SELECT r, p, bool_or(c > 1) AS twice, bool_or(k > 1) AS again
        FROM (SELECT r, c, k, unnest(range(i, i + {n})) AS p FROM g{n} WHERE c > 1) GROUP BY r, p)
  JOIN d USING (r) GROUP BY r
)""")
        joins.append(f"LEFT JOIN c{n} USING (r)")
    for n, limit in repetition.GRAM_LIMITS.items():
        share = f"CASE WHEN word_chars > 0 THEN CAST(coalesce(c{n}.chars, 0) AS DOUBLE) / word_chars ELSE 0.0::DOUBLE END"
        shares.append(f"{share} AS dup_{n}gram_share")
        over.append(f"dup_{n}gram_share > {limit}::DOUBLE")
    return f"""WITH
d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_words("coalesce(text, '')", _SPACED)} AS w
  FROM documents
),
lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY p) AS k
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)
  WHERE regexp_matches(line, {_quote(_SPACED)})
),
l AS (
  SELECT r, count(*) FILTER (k > 1) AS dup, sum(len(line)) AS chars, coalesce(sum(len(line)) FILTER (k > 1), 0) AS dup_chars
  FROM lines GROUP BY r
),
{", ".join(parts)},
base AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(list_sum([len(x) for x in w]), 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols
  FROM d
),
m AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c{repetition.BASE_GRAM}.places, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN l.chars > 0 THEN CAST(l.dup_chars AS DOUBLE) / l.chars ELSE 0.0::DOUBLE END AS dup_line_share,
    {", ".join(shares)}
  FROM base LEFT JOIN l USING (r) {" ".join(joins)}
),
f AS (
  SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT *, NOT base_failed AND NOT (dup_line_share > {repetition.LINE_LIMIT}::DOUBLE OR {" OR ".join(over)}) AS kept FROM f"""


#: Patterns of secrets as this engine has them: leftmost matches, neither looking back nor keeping what was taken.
#: kind, pattern, the group that is the value, its least length, whether it is a base kind.
_BLANK = r"\x20\x09-\x0D"
SECRETS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True),
    ("bearer", r"(?:[Bb]earer|BEARER)\x20+([A-Za-z0-9+/_.=~-]{20,})", 1, 20, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False),
    ("prefixed", r"(?:gh[opsru]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{20,}", 0, 24, False),
    ("url", rf"[a-z0-9+]{{2,}}://[^{_BLANK}/:@]*:([^{_BLANK}/:@]{{6,}})@", 1, 6, False),
    (
        "key",
        rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.{_BLANK}-]{{64,}}?-----END [A-Z ]*PRIVATE KEY-----"
        rf"|[A-Za-z0-9+/={_BLANK}]{{64,}})",
        0,
        90,
        False,
    ),
)


def _secrets() -> str:
    parts = []
    for rank, (kind, pattern, group, least, _) in enumerate(SECRETS):
        p = _quote(pattern)
        parts.append(f"""SELECT r, {rank} AS k, '{kind}' AS kind,
  list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in m[1:i - 1]]), 0) AS s,
  len(m[i]) AS size, v[i] AS v
FROM (SELECT r, gaps, m, v, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT r, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS m,
              regexp_extract_all(t, {p}, {group}) AS v FROM d WHERE regexp_matches(t, {p})))
WHERE len(v[i]) >= {least}""")
    base = sum(x[4] for x in SECRETS)

    def listed(where: str) -> str:
        return f"coalesce(string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, k) FILTER ({where}), '')"

    def count(kind: str) -> str:
        return f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"

    return f"""WITH
d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, source AS owner,
    coalesce(source, '') || chr(10) || coalesce(lang, '') AS repository
  FROM documents
),
found AS ({" UNION ALL ".join(parts)}),
pairs AS (SELECT DISTINCT v, owner, repository FROM found JOIN d USING (r)),
examples AS (
  SELECT v FROM (SELECT v, owner, count(*) AS n FROM pairs GROUP BY v, owner) GROUP BY v
  HAVING count(*) >= 3 AND sum(n) >= 3
),
marked AS (SELECT r, k, kind, s, size, examples.v IS NOT NULL AS copied FROM found LEFT JOIN examples USING (v))
SELECT any_value(doc_id) AS doc_id, {count("assign")}, {count("access")}, {count("hex")},
  sha256({listed(f"k < {base}")}) AS base_sha256, {listed(f"k < {base} OR NOT copied")} AS spans,
  CAST(count(*) FILTER (NOT copied) AS BIGINT) AS n_live, CAST(count(*) FILTER (copied) AS BIGINT) AS n_example
FROM d LEFT JOIN marked USING (r) GROUP BY r"""


def _licenses() -> str:
    phrases = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        phrases.append(f"""SELECT r, i - 1 AS i, '{label}' AS label
FROM (SELECT r, w, unnest(range(1, len(w) - {len(parts)} + 2)) AS i FROM d) WHERE {same}""")
    templates = []
    for label, text in licenses.TEMPLATES:
        own, total = licenses.template_words(text), len(re.findall("[0-9a-z]+", text.lower()))
        lists = own, licenses.naming_words(label, text), [*licenses.OTHERS.get(label, ())]
        templates.append(f"('{label}', {', '.join(f'CAST({x} AS VARCHAR[])' for x in lists)}, {total})")
    rows = ", ".join(templates)
    return f"""WITH
d AS (
  SELECT doc_id, row_number() OVER () AS r, {_lowered("text")} AS t, {_words(_lowered("text"), _PLAIN)} AS w FROM documents
),
places AS ({" UNION ALL ".join(phrases)}),
base AS (
  SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY r
),
templates(label, own, names, others, total) AS (VALUES {rows}),
vocabulary AS (SELECT list(DISTINCT x) AS words FROM (SELECT unnest(own || others) AS x FROM templates)),
lines AS (
  SELECT r, [regexp_extract_all(line, {_quote(_PLAIN)}) for line in string_split(t, chr(10))] AS w FROM d
),
blocks AS (
  SELECT r, false AS run, unnest(w) AS w FROM lines
  UNION ALL
  SELECT r, true, flatten(w[i:i + 11])
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM lines WHERE len(w) > 1), vocabulary
  WHERE list_has_any(w[i], words)
),
met AS (
  SELECT r, label, CAST(shared AS DOUBLE) / size AS containment
  FROM (
    SELECT r, run, w, label, names, others, total, len(list_intersect(list_distinct(w), own)) AS shared, len(own) AS size
    FROM blocks, templates
  )
  WHERE list_has_all(w, names) AND NOT list_has_any(w, others)
    AND CASE WHEN size < 16 THEN shared = size AND NOT run AND len(w) <= size + 12
        ELSE 100 * shared >= 80 * size AND (NOT run OR len(w) <= 4 * total) END
),
best AS (SELECT r, list(DISTINCT label) AS labels, max(containment) AS best FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '')
    AS labels,
  greatest(coalesce(best, 0.0::DOUBLE), CASE WHEN base.n > 0 THEN {licenses.PHRASE_SCORE} ELSE 0.0 END::DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""


JACCARD = f"""WITH RECURSIVE
d AS (SELECT doc_id, {_words(_lowered("text"), _SPACED)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS grams
  FROM d
),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS both_have
    FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  WHERE 100 * both_have >= 90 * (m + n - both_have)
),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, CAST(min(b) AS BIGINT) AS component_id
FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, len(grams)"""

#: crc32 byte by byte, with its table of 256 made from the polynomial; near words by the strings that a deletion leaves.
VARIANTS = f"""WITH RECURSIVE
steps AS (
  SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) AS t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, {_lowered("text")} AS t FROM documents),
found AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM d),
runs AS (SELECT r, doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS h FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT),
      [CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) for i in range(1, length(h) // 2 + 1)]),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM coded, crc
),
kept AS (
  SELECT n, CASE WHEN crc % 199 = 0
    THEN left(run, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2) ELSE run END AS word
  FROM summed
),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, CASE WHEN i < 0 THEN word ELSE left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) END AS part
  FROM (SELECT word, n, unnest(range(-1, length(word))) AS i FROM w)
),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS n
  FROM cut a JOIN cut b USING (part) WHERE a.word <> b.word AND (a.i = b.i OR a.i < 0 OR b.i < 0)
),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
),
path AS (
  SELECT word, word AS at, form AS further FROM forms
  UNION ALL
  SELECT path.word, forms.word, forms.form FROM path JOIN forms ON forms.word = path.further
)
SELECT forms.word, forms.form, path.at AS root, forms.n, CAST(forms.n_near AS BIGINT) AS n_near, forms.form_n
FROM forms JOIN path ON path.word = forms.word AND path.further IS NULL"""


ORACLE: dict[str, str] = {
    "op2_secret_scan": _secrets(),
    "op4_decontamination": DECONTAMINATION,
    "op5_repetition_rules": _repetition(),
    "op7_license_scan": _licenses(),
    "op8_jaccard_join": JACCARD,
    "op11_spelling_variants": VARIANTS,
}
