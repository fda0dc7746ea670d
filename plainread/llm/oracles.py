"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

from plainread.llm.license_scan import COVERAGE, DRIFT, MIN_VOTES, NOTICES, PHRASES

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT body, max(page_id) AS target FROM p WHERE strlen(body) >= 1000 GROUP BY body),
j AS (SELECT p.page_id, p.body, CASE WHEN m.target <> p.page_id THEN m.target END AS refers_to
      FROM p LEFT JOIN m USING (body))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j
"""


SHINGLES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def license_sql() -> str:
    """The same votes on flat rows: word pairs joined with the templates' pairs."""
    rows = ", ".join(f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, '{text}')"
                     for i, (label, text) in enumerate([*PHRASES, *NOTICES]))
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i - 1 AS place, ws[i] AS a, ws[i + 1] AS b
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
t(template, label, exact, body) AS (VALUES {rows}),
g AS (
  SELECT template, label, exact, len(ws) - 1 AS grams, i - 1 AS spot, ws[i] AS a, ws[i + 1] AS b
  FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM (SELECT *, string_split(body, ' ') AS ws FROM t))),
v AS (
  SELECT doc_id, template, label, exact, grams, place - spot AS diagonal, list(DISTINCT spot) AS ats
  FROM p JOIN g USING (a, b) GROUP BY ALL),
base AS (
  SELECT doc_id, label, true AS exact, diagonal AS first, 1.0::DOUBLE AS share FROM v
  WHERE exact AND len(ats) = grams),
o AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER d <= {DRIFT} THEN 0 ELSE 1 END AS opens
  FROM v WHERE NOT exact AND len(ats) >= least({MIN_VOTES}, grams)
  WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM o),
m AS (
  SELECT doc_id, label, grams, band, template, min(diagonal + list_min(ats)) AS first,
    max(diagonal + list_max(ats) + 1) AS last, len(list_distinct(flatten(list(ats)))) AS held
  FROM b GROUP BY ALL),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT doc_id, label, false, first, held::DOUBLE / grams FROM m
  WHERE held::DOUBLE / grams >= {COVERAGE} AND last - first + 1 <= 2 * (grams + 1)),
d AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word,
    max(first) FILTER (exact) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN d ON w.doc_id = d.doc_id
"""


def crc32_sql(text: str) -> str:
    """crc32 (IEEE) of a text's UTF-8 bytes: a table ``crc`` of 256 entries made by the rule, folded over the bytes."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"""


CRC_TABLE = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(
  list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc)"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM r, crc_table),
t AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2)
    ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (
  SELECT word, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS cut
  FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
m AS (
  SELECT p.word, count(*) AS n_near, min({{'n': -v.n, 'other': p.other}}) AS best
  FROM p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 5 * v.n THEN best.other END AS form,
    CASE WHEN -best.n >= 5 * v.n THEN -best.n END AS form_n
  FROM v LEFT JOIN m ON m.word = v.word),
s AS (
  SELECT word, word AS spot, form AS next FROM f
  UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.spot AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL
"""


def merkle_sql() -> str:
    """Levels of runs by a recursion over rows, then a recursion up each document's runs."""
    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    left = "array_to_string(ds[1:p.spot % 16], '')"
    right = "array_to_string(ds[p.spot % 16 + 2:], '')"
    return f"""
WITH RECURSIVE {CRC_TABLE},
l AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT doc_id, coalesce('=' || source, '') AS k, {leaf("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents, crc_table)),
t AS (
  SELECT k, 0 AS level, spot, leaf AS digest, n FROM l
  UNION ALL
  SELECT k, level + 1, spot // 16, sha256(string_agg(digest, '' ORDER BY spot)), (any_value(n) + 15) // 16
  FROM t WHERE n > 1 GROUP BY k, level, spot // 16),
u AS (
  SELECT k, 0 AS level, row_number() OVER (ORDER BY k) - 1 AS spot, digest, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT any_value(k), level + 1, spot // 16, sha256(string_agg(digest, '' ORDER BY spot)), (any_value(n) + 15) // 16
  FROM u WHERE n > 1 GROUP BY level, spot // 16),
runs AS (
  SELECT k, level, spot // 16 AS run, list(digest ORDER BY spot) AS ds FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, spot // 16 AS run, list(digest ORDER BY spot) AS ds FROM u WHERE n > 1 GROUP BY ALL),
up AS (
  SELECT l.k, l.spot AS leaf_at, 0 AS level, l.spot AS spot, coalesce(l.changed, l.leaf) AS value, '' AS beside FROM l
  UNION ALL
  SELECT p.k, leaf_at, p.level + 1, p.spot // 16, sha256({left} || value || {right}), beside || {left} || {right}
  FROM up p JOIN runs ON runs.k = p.k AND runs.level = p.level AND runs.run = p.spot // 16),
sub AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY k, leaf_at ORDER BY level DESC) = 1),
top AS (
  SELECT sub.k, leaf_at, 0 AS level, u.spot, value, beside, u.digest AS subroot
  FROM sub JOIN u ON u.k = sub.k AND u.level = 0
  UNION ALL
  SELECT p.k, leaf_at, p.level + 1, p.spot // 16, sha256({left} || value || {right}), beside || {left} || {right}, subroot
  FROM top p JOIN tops ON tops.level = p.level AND tops.run = p.spot // 16),
done AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY k, leaf_at ORDER BY level DESC) = 1),
r AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, done.subroot, r.root, sha256(beside) AS proof_sha256, value AS folded_root,
  value = r.root AS verified
FROM l JOIN done ON done.k = l.k AND done.leaf_at = l.spot, r
"""


def all_sql() -> dict[str, str]:
    return {"op3_warc": WARC, "op6_jaccard_join": SHINGLES, "op8_exact_dedup": EXACT_DEDUP,
            "op9_license_scan": license_sql(),
            "op11_spelling": SPELLING, "op12_merkle": merkle_sql()}
