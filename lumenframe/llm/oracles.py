"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from lumenframe.llm.chat_format import END, PART_TURNS, START

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = f"""
WITH said AS (
  SELECT *, md5(role || chr(10) || text) AS hash FROM (
    SELECT DISTINCT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text,
           coalesce(turn // {PART_TURNS}, -1)::BIGINT AS part
    FROM conversations)),
numbered AS (SELECT DISTINCT conv_id, part, turn, count(*) OVER (PARTITION BY conv_id, turn) AS n, count(*) OVER (PARTITION BY conv_id, part) AS total FROM said),
began AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM numbered),
cut AS (
  SELECT said.*, CASE WHEN total > {PART_TURNS} THEN ((start + floor(('0x' || hash[1:8])::BIGINT / 4294967296.0::DOUBLE * n)) // {PART_TURNS})::BIGINT ELSE 0 END AS piece
  FROM said JOIN began ON said.conv_id IS NOT DISTINCT FROM began.conv_id AND said.turn IS NOT DISTINCT FROM began.turn),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM said WHERE role <> 'system'),
each AS (
  SELECT conv_id, speaker, part, piece, role = speaker AS own,
         '{START}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
         text || '{END}' AS body,
         row_number() OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, hash) AS k
  FROM cut JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, sum(length(head || body)) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY k) - length(body) AS pos FROM each)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body, '' ORDER BY k) AS text,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY k) AS mask,
       coalesce(string_agg(pos::BIGINT || '-' || (pos + length(body) - 1)::BIGINT, ',' ORDER BY k) FILTER (own), '') AS spans
FROM placed GROUP BY conv_id, speaker, part, piece"""

_OP2 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {SPACE_WORDS} AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
five AS (
  SELECT doc_id, i, word, lag(word) OVER d AS before,
         [word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] AS win,
         lead(word, 4) OVER d IS NOT NULL AS whole
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, word, before, whole AND count(*) FILTER (whole) OVER (PARTITION BY doc_id, win) > 1 AS hit FROM five),
covered AS (
  SELECT doc_id, word IS NOT DISTINCT FROM before AS adjacent,
         bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM counted),
by_word AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words, count(*) FILTER (adjacent) AS n_adjacent FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
by_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent,
         length(regexp_replace(text, '\P{{L}}', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '\P{{Lu}}', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
bits AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (n_letters >= 20 AND 100 * n_upper > 50 * n_letters)::INT
    + 32 * (n_words >= 10 AND 100 * n_adjacent > 30 * n_words)::INT + 64 * (n_words >= 10 AND word_chars > 40 * n_words)::INT)::BIGINT AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM bits"""

_ALNUM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP6 = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS words FROM benchmark),
pattern AS (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (
    SELECT item, words, least(13, len(words)) AS size, unnest(generate_series(1, greatest(len(words) - 12, 1))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM pattern),
win AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win FROM (
    SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM d, sizes WHERE len(words) >= size)),
hit AS (SELECT doc_id, i, size, item FROM win JOIN pattern USING (size, win)),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN spot USING (doc_id) LEFT JOIN item USING (doc_id)"""

# CRC-32 byte by byte over its table, and the published jump generator modulo 2 ** 64. Slots follow (id, size, checksum):
# tables of up to 160,000 distinct rows, to which this SQL is held, have one bin.
_OP8 = """
WITH RECURSIVE bit(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM bit WHERE k = 8),
byte AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32
  FROM byte, tab),
jump(id, key, b) AS (
  SELECT DISTINCT doc_id, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UHUGEINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT id, next, floor((b + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT FROM (
    SELECT id, b, (key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS next FROM jump WHERE b < 9)),
shard AS (SELECT id, (max(b) FILTER (b < 8))::INT AS shard, (max(b) FILTER (b < 9))::INT AS grown_shard FROM jump GROUP BY id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN shard ON doc_id IS NOT DISTINCT FROM id"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, {SPACE_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, n_words, pos, md5(array_to_string(words[pos + 1:pos + 50], ' ')) AS w FROM (
    SELECT doc_id, words, len(words)::BIGINT AS n_words, unnest(generate_series(0, len(words) - 50)) AS pos FROM d WHERE len(words) >= 50)),
placed AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS n, min(doc_id) OVER (PARTITION BY w) AS lowest, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM win),
hit AS (SELECT *, k > 1 AS later FROM placed WHERE n > 1),
marked AS (SELECT 'all' AS kind, doc_id, pos FROM hit UNION ALL SELECT 'later', doc_id, pos FROM hit WHERE later),
starts AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY kind, doc_id ORDER BY pos) + 50, true)::INT AS new FROM marked),
runs AS (SELECT *, sum(new) OVER (PARTITION BY kind, doc_id ORDER BY pos) AS run FROM starts),
spans AS (SELECT kind, doc_id, min(pos) AS s, max(pos) + 50 AS e FROM runs GROUP BY kind, doc_id, run),
per AS (SELECT kind, doc_id, sum(e - s)::BIGINT AS n, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM spans GROUP BY kind, doc_id),
ids AS (SELECT doc_id, n_words, string_agg(DISTINCT lowest::VARCHAR, ',' ORDER BY lowest::VARCHAR) AS unsorted, list_sort(list(DISTINCT lowest)) AS firsts FROM hit GROUP BY doc_id, n_words)
SELECT a.doc_id, n_words, a.n AS n_repeated, coalesce(l.n, 0)::BIGINT AS n_removed, a.spans, coalesce(l.spans, '') AS removed, array_to_string(firsts, ',') AS first_ids
FROM (SELECT * FROM per WHERE kind = 'all') a LEFT JOIN (SELECT * FROM per WHERE kind = 'later') l USING (doc_id) JOIN ids USING (doc_id)"""

_OP10 = r"""
WITH line AS (
  SELECT doc_id, line, i, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
worded AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE worded),
win AS (
  SELECT doc_id, k, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM win WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + unnest([0, 1, 2]) AS k FROM later),
lost AS (SELECT doc_id, i FROM worded JOIN gone USING (doc_id, k)),
rest AS (SELECT line.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM line ANTI JOIN lost USING (doc_id, i) GROUP BY line.doc_id),
n AS (SELECT doc_id, count(*) AS lines_removed FROM lost GROUP BY doc_id)
SELECT d.doc_id, coalesce(lines_removed, 0) AS lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text
FROM documents d LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)"""

SQL = {
    "op1_perspective_rotation": _OP1,
    "op2_quality_rules": _OP2,
    "op6_decontaminate": _OP6,
    "op8_jump_sharding": _OP8,
    "op9_suffix_dedup": _OP9,
    "op10_line_dedup": _OP10,
}
