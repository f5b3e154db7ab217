"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_NON_ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JACCARD = rf"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM words),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * i >= 90 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc, other) AS (SELECT a, b FROM ways UNION SELECT r.doc, e.b FROM reach r JOIN ways e ON r.other = e.a),
least_of AS (SELECT doc, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) LEFT JOIN least_of l ON l.doc = d.doc_id
"""

DECONTAMINATION = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_NON_ASCII_WORD}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_NON_ASCII_WORD}') AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, greatest(2, len(w) - 8)),
    lambda i: array_to_string(w[i:i + 9], ' '))) AS p
  FROM item WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM pattern),
place AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM doc, lengths WHERE len(w) >= m),
found AS (
  SELECT a.doc_id, a.i, a.m, p.item_id FROM place a JOIN pattern p
    ON p.m = a.m AND p.p = array_to_string(a.w[a.i:a.i + a.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH line AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
keyed AS (SELECT doc_id, line, pos,
  {_LOWER.format("regexp_replace(line, '^[" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D]+|[" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D]+$', '', 'g')")} AS k
  FROM line),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""

QUALITY_RULES = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
gram AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM doc WHERE len(w) >= 3),
named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM gram),
twice AS (SELECT doc_id, g FROM named GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM named JOIN twice USING (doc_id, g)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{_SPACE}') GROUP BY 1),
each_word AS (SELECT doc_id, x, count(*) AS n, bool_or(regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')) AS letter
  FROM (SELECT doc_id, unnest(w) AS x FROM doc) GROUP BY 1, 2),
per_doc AS (SELECT doc_id, sum(n * length(x)) AS chars, max(n) AS top, sum(n) FILTER (WHERE NOT letter) AS letterless
  FROM each_word GROUP BY 1),
base AS (
  SELECT d.doc_id, d.text, len(w)::BIGINT AS n_words, coalesce(p.chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (coalesce(l.n, 0) - coalesce(l.d, 0))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    p.top, coalesce(p.letterless, 0) AS letterless
  FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN per_doc p USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')) + 1
    OR 5 * letterless > n_words
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
    OR 10 * top > 3 * n_words) AS kept
FROM judged
"""


PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END),
      xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id),
heads AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT h.conv_id, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL SELECT h.conv_id, t.pos - h.h + h.k, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos >= h.h),
path AS (
  SELECT conv_id, pos + 1 AS depth, octet_length(encode(text)) AS n_bytes,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes FROM path GROUP BY depth, k),
born AS (SELECT depth - 1 AS depth, substr(k, 1, 64 * (depth - 1)::INTEGER) AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
valued AS (SELECT node.*, coalesce(born.n, 0) AS n_children FROM node LEFT JOIN born USING (depth, k)),
whole AS (
  SELECT d AS depth, substr(k, 1, 64 * d::INTEGER) AS k, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * n_bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1, 2),
ends AS (
  SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e
  FROM (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM path GROUP BY conv_id) GROUP BY depth, k)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, w.n_leaves, w.saved_tokens,
  coalesce(e.e, sha256('')) AS ends_sha256
FROM valued v JOIN whole w USING (depth, k) LEFT JOIN ends e USING (depth, k)
LEFT JOIN node p ON p.depth = v.depth - 1 AND p.k = substr(v.k, 1, 64 * greatest(v.depth - 1, 0)::INTEGER)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": NGRAM_JACCARD, "op4_decontamination": DECONTAMINATION, "op8_line_dedup": LINE_DEDUP,
            "op9_quality_rules": QUALITY_RULES, "op11_prefix_trie": PREFIX_TRIE}
