"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM docs GROUP BY source),
-- Sources are full from the smallest ratio of limit to weight on, as far as their limit is
-- under what an equal level would give them.
ordered AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS full_words, sum(weight) OVER after AS open_weight,
    sum(source_size) OVER () AS words
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT CAST(words - full_words AS DOUBLE) AS top, CAST(open_weight AS DOUBLE) AS bottom FROM ordered
  WHERE 3 * source_size * open_weight >= weight * (words - full_words)
  ORDER BY 3 * source_size / weight, source LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size * bottom < weight * top THEN CAST(3 * source_size AS DOUBLE)
      ELSE weight * top / bottom END AS target
  FROM sources, level),
cut AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST(
    budget // source_size * size + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken
FROM cut
"""

RULES = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS n, len(w) AS n_words
  FROM docs, unnest(range(1, len(w) - 3)) AS t(i)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, unnest(range(0, 5)) AS t(k) WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_shouted,
    len(list_filter(w, lambda x: x LIKE '%!!')) AS n_marked
  FROM docs LEFT JOIN repeated USING (doc_id)),
failed AS (
  SELECT *,
    n_words < 10 AS r0, 100 * n_repeat_words > 20 * n_words AS r1, 100 * n_symbols > 10 * n_words AS r2,
    n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines AS r3, word_chars > 14 * n_words AS r4,
    n_words >= 50 AND word_chars < 2 * n_words AS r5, n_words >= 10 AND 100 * n_shouted > 60 * n_words AS r6,
    100 * n_marked > 30 * n_words AS r7
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
  NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7) AS kept,
  CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT + 128 * r7::INT AS INT)
    AS failures
FROM failed
"""

EXACT = r"""
WITH docs AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM docs WINDOW same AS (PARTITION BY text_sha256)
"""

NEAR = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_reduce(w[i : i + 4], lambda a, b: a || ' ' || b) AS s
  FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes m ON a = m.doc_id JOIN sizes n ON b = n.doc_id
  WHERE 100 * inter >= 85 * (m.n + n.n - inter)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""

TRIE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS said FROM turns GROUP BY conv_id),
borrowing AS (
  SELECT conv_id, said, conv_id - conv_id % 100 AS root,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))) % 6 AS h
  FROM own, crc),
rebuilt AS (
  SELECT c.conv_id,
    list_concat(CASE WHEN r.said IS NULL THEN [] ELSE r.said[1 : h] END, c.said[h + 1 : len(c.said)]) AS seq
  FROM borrowing c LEFT JOIN own r ON c.root = r.conv_id),
members AS (
  SELECT conv_id, d AS depth, seq[1 : d] AS path, d = len(seq) AS ends FROM rebuilt, unnest(range(0, len(seq) + 1)) AS t(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(path[depth].text) END AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
children AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
below AS (
  SELECT path[1 : d] AS path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM counted, unnest(range(0, depth + 1)) AS t(d) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON n.path = b.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1]
"""

ORACLE = {
    "op2_source_mix": MIX,
    "op5_quality_rules": RULES,
    "op7_exact_dedup": EXACT,
    "op8_near_dedup": NEAR,
    "op12_prefix_trie": TRIE,
}
