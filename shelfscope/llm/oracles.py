"""DuckDB counterparts of the registered queries."""

from __future__ import annotations

from shelfscope.llm.license_scan import PHRASE_BIT, LicenseIndex, _places, plain_words
from shelfscope.llm.quality_rules import LineRules

_RULES = LineRules()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quality(rules: LineRules = _RULES) -> str:
    space = r"[\x20\x09-\x0D]"
    boiler = " OR ".join(f"contains(lower(line), {_text(p)})" for p in rules.phrases)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs
), win AS (
  SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win WHERE win IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY rid
), line AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs
), judged AS (
  SELECT rid, line, length(regexp_replace(line, '{space}', '', 'g')) AS chars,
         regexp_replace(line, '^{space}+|{space}+$', '', 'g') AS bare
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), passed AS (
  SELECT *, contains({_text(rules.endings)}, right(bare, 1))
    AND NOT (len(regexp_extract_all(bare, '[|»›•·]')) >= 2
             AND len(regexp_extract_all(bare, '[|»›•·]')) >= {rules.separator_share} * (1 + len(regexp_extract_all(bare, '[ \t]'))))
    AND NOT len(regexp_extract_all(bare, '[#*$%&|<>]')) > {rules.symbol_share} * chars
    AND NOT ({boiler}) AS good
  FROM judged
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup, coalesce(sum(chars) FILTER (good), 0) AS good_chars FROM passed GROUP BY rid
), counted AS (
  SELECT d.rid, d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.good_chars, 0) AS good_chars
  FROM docs d LEFT JOIN lines l USING (rid) LEFT JOIN repeats r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {round(100 * rules.max_repeat_share)} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {round(100 * rules.max_repeat_share)} * n_words)
         AND word_chars - good_chars <= {rules.max_loss} * word_chars AS kept
FROM counted
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_TERMS}') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}'), []) AS w FROM documents
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM win
), place AS (
  SELECT rid, s, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n)
), hit AS (
  SELECT rid, s, n, item_id FROM place JOIN win USING (win)
), words AS (
  SELECT rid, count(DISTINCT at_word) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS at_word FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""



def _rows(rows: list[tuple]) -> str:
    cell = lambda v: _text(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def _licenses(index: LicenseIndex | None = None) -> str:
    index = index or LicenseIndex()
    notices = [(i, place, w) for i, t in enumerate(index.templates) for place, w in enumerate(plain_words(t.text))]
    runs, seats = [], []
    phrases = list(dict.fromkeys([p for t in index.templates for p in t.phrases] + list(index.base)))
    for number, phrase in enumerate(phrases):
        words = plain_words(phrase)
        runs += [(number, place, w, len(words)) for place, w in enumerate(words)]
        for i, t in enumerate(index.templates):
            if phrase in t.phrases:
                seats += [(number, i, place, PHRASE_BIT + t.phrases.index(phrase)) for place in _places(words, plain_words(t.text))]
    base = [(phrases.index(p), label) for p, label in index.base.items()]
    told = [(i, t.label, len(t.phrases)) for i, t in enumerate(index.templates)]
    return rf"""
WITH notice(template, place, word) AS (VALUES {_rows(notices)}),
run(phrase, place, word, n) AS (VALUES {_rows(runs)}),
seat(phrase, template, seat, bit) AS (VALUES {_rows(seats)}),
base(phrase, label) AS (VALUES {_rows(base)}),
told(template, label, n_phrases) AS (VALUES {_rows(told)}),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents
), word AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM doc
), frequency AS (
  SELECT word, count(DISTINCT rid) AS df FROM word GROUP BY word
), ranked AS (
  SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(df, 0), word) - 1 AS bit, count(*) OVER (PARTITION BY template) AS n_distinct
  FROM (SELECT DISTINCT template, word FROM notice) LEFT JOIN frequency USING (word)
), rare AS (
  SELECT template, word, bit FROM ranked WHERE bit < greatest(1, least({index.rare}, n_distinct // 2))
), agreed AS (
  SELECT rid, phrase, pos - place AS start FROM word JOIN run USING (word) GROUP BY rid, phrase, n, pos - place HAVING count(*) = n
), based AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS base_labels
  FROM agreed JOIN base USING (phrase) GROUP BY rid
), near AS (
  SELECT rid, template, pos - place AS start, bit FROM word JOIN rare USING (word) JOIN notice USING (template, word)
  UNION ALL SELECT rid, template, start - seat, bit FROM agreed JOIN seat USING (phrase)
), finds AS (
  SELECT rid, template, count(DISTINCT bit) FILTER (bit < {PHRASE_BIT}) AS agree, count(DISTINCT bit) FILTER (bit >= {PHRASE_BIT}) AS n_found
  FROM (SELECT *, unnest([0, {index.width // 2}]) AS shift FROM near)
  GROUP BY rid, template, shift, floor((start + shift) / {index.width})
), verified AS (
  SELECT rid, label, agree / n_rare AS share FROM finds JOIN told USING (template)
  JOIN (SELECT template, count(*) AS n_rare FROM rare GROUP BY template) USING (template)
  WHERE n_found = n_phrases AND agree * 100 >= n_rare * {index.need_percent}
), found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(share) AS score FROM verified GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(coalesce(base_labels, []::VARCHAR[]), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []::VARCHAR[]), coalesce(labels, []::VARCHAR[])))), ',') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN based USING (rid) LEFT JOIN found USING (rid)
"""


# crc32 bit by bit: a list of the bytes, each followed by eight marks for a shift.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len({0}) + 1), lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""

PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, {_CRC32.format("(conv_id::VARCHAR)")} % 9 AS h,
         list({{'id': md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'size': strlen(coalesce(text, ''))}}
              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), path AS (
  SELECT conv_id, list_transform(turns, lambda t: t.id) AS ids, list_transform(turns, lambda t: t.size) AS sizes, unnest(range(len(turns) + 1)) AS depth FROM rebuilt
), node AS (
  SELECT depth, list_slice(ids, 1, depth) AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(any_value(sizes[depth]), 0) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth) AS ends
  FROM path GROUP BY depth, list_slice(ids, 1, depth)
), child AS (
  SELECT depth - 1 AS depth, list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (depth, prefix)
), below AS (
  SELECT up AS depth, list_slice(prefix, 1, up) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY up, list_slice(prefix, 1, up)
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN below b USING (depth, prefix) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": DECONTAMINATION, "op6_quality_rules": _quality(), "op11_license_scan": _licenses(), "op12_prefix_trie": PREFIX_TRIE,
}
