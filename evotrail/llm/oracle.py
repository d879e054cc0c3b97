"""SQL that gives the expected rows of the operators that SQL can express.

It works on whole tables without seeds, groups, anchors or blocks: every pair of equal
words for op1, every pair of vectors for op8, every window for op9, every draw for op10,
every rule for op13.
"""

from __future__ import annotations

from evotrail.llm.decontamination import SUBSTITUTIONS, WINDOW
from evotrail.llm.sharding import DRAW_DIGITS, RECORD_OVERHEAD

SHARDS, REPEATED_WINDOW, COSINE = 40, 35, 0.95

_WORDS = (
    r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),"
    " lambda word: word <> '')"
)

# Pairs of equal words on one diagonal, and those diagonals where enough lie close together.
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (
  SELECT min(item_id) AS item_id, words FROM (SELECT item_id, {_WORDS} AS words FROM benchmark)
  WHERE len(words) >= {WINDOW} GROUP BY words),
doc_words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p
  FROM docs WHERE len(words) >= {WINDOW}),
item_words AS (
  SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM items),
equal AS (
  SELECT doc_id, item_id, p - q AS shift, count(*) OVER (
    PARTITION BY doc_id, item_id, p - q ORDER BY q
    RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS near
  FROM doc_words JOIN item_words USING (word)),
aligned AS (
  SELECT DISTINCT c.doc_id, c.item_id, shift, d.words AS a, i.words AS b,
    greatest(1, 1 - shift) AS first, least(len(i.words), len(d.words) - shift) AS last
  FROM equal c JOIN docs d USING (doc_id) JOIN items i ON c.item_id = i.item_id
  WHERE near >= {WINDOW - SUBSTITUTIONS}),
agreeing AS (
  SELECT doc_id, item_id, len(b) AS item_words, list_transform(range(first, last + 1),
    lambda q: CASE WHEN a[q + shift] = b[q] THEN 1 ELSE 0 END) AS agree
  FROM aligned),
found AS (
  SELECT *, list_filter(range(1, len(agree) - {WINDOW - 2}),
    lambda s: list_sum(agree[s:s + {WINDOW - 1}]) >= {WINDOW - SUBSTITUTIONS}) AS good
  FROM agreeing),
covering AS (
  SELECT *, list_distinct(flatten(list_transform(good, lambda s: range(s, s + {WINDOW})))) AS covered
  FROM found WHERE len(good) > 0),
ranked AS (
  SELECT doc_id, item_id, item_words, len(good) AS windows, len(covered) AS covered_words,
    list_sum(list_transform(covered, lambda s: agree[s])) AS equal_words
  FROM covering)
SELECT doc_id, item_id, item_words, CAST(windows AS INTEGER) AS windows,
  CAST(covered_words AS INTEGER) AS covered_words, CAST(equal_words AS INTEGER) AS equal_words
FROM ranked
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
  ORDER BY windows DESC, covered_words DESC, equal_words DESC) = 1"""


def _draw(shard: str) -> str:
    digits = f"substr(md5(key || ':' || {shard}), 1, {DRAW_DIGITS})"
    return f"ln((CAST('0x' || {digits} AS BIGINT) + 0.5) / {16**DRAW_DIGITS}.0)"


# The table of the reflected CRC-32 polynomial, then one step for each byte.
SHARDING = f"""
WITH RECURSIVE steps(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1
  FROM steps WHERE k < 8),
polynomial AS (SELECT list(c ORDER BY n) AS crc FROM steps WHERE k = 8),
keyed AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda pair: CAST('0x' || pair AS BIGINT)) AS bytes
  FROM documents),
sized AS (
  SELECT doc_id, key, len(bytes) + {RECORD_OVERHEAD} AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
      lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS text_crc32
  FROM keyed, polynomial),
drawn AS (
  SELECT key, shard, {_draw("shard")} AS score
  FROM (SELECT DISTINCT key FROM keyed), range({SHARDS + 1}) AS shards(shard)),
placed AS (
  SELECT key, arg_max(shard, score) FILTER (WHERE shard < {SHARDS}) AS shard,
    arg_max(shard, score) AS grown_shard
  FROM drawn GROUP BY key)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(key), text_crc32, size) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (key)"""

# Null, zero and non-finite vectors have no unit vector and are in no pair.
VECTORS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT vec_id, v FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM vectors
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id,
  vec_id = min(other) AS kept
FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id"""

SUBSTRINGS = f"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
    lambda word: word <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, first,
    md5(array_to_string(words[first:first + {REPEATED_WINDOW - 1}], ' ')) AS code
  FROM (SELECT *, unnest(range(1, len(words) - {REPEATED_WINDOW - 2})) AS first FROM split)),
repeated AS (SELECT code FROM windows GROUP BY code HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, first + step AS place
  FROM windows SEMI JOIN repeated USING (code), range({REPEATED_WINDOW}) AS steps(step)),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
  FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_over USING (doc_id)"""

# Every rule against every url; what stands for a pattern is its regular expression.
URLS = """
WITH rules(place, host, path, verdict) AS (VALUES
    (0, 'org', '/', 'allow'), (1, 'example.org', '/es/', 'block'),
    (2, 'example.org', '/en/1', 'block'), (3, 'com', '/fr/', 'allow'), (4, 'com', '/de/', 'block')),
patterns(pattern, form) AS (VALUES
    ('cheap-pills.*/', '^([^/]*[.])?cheap-pills[.][^/]*/'),
    ('spam-farm.*/', '^([^/]*[.])?spam-farm[.][^/]*/'),
    ('casino.*/', '^([^/]*[.])?casino[.][^/]*/'),
    ('*/wp-login.php', '^[^/]*/wp-login[.]php'), ('*/wp-admin/', '^[^/]*/wp-admin/'),
    ('*/cgi-bin/', '^[^/]*/cgi-bin/'), ('*/*/calendar/*/day/', '^[^/]*/.*/calendar/.*/day/')),
parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', ['host', 'path']) AS found
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
addresses AS (
  SELECT row_number() OVER () AS row, page_id, found.path AS path, translate(found.host,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
ruled AS (
  SELECT row, arg_max({'rule': r.host || r.path, 'verdict': r.verdict},
    [length(r.host || r.path), length(r.host), -r.place]) AS best
  FROM addresses a JOIN rules r
    ON ('.' || a.host) LIKE ('%.' || r.host) AND starts_with(a.path, r.path)
  GROUP BY row),
shaped AS (
  SELECT row, arg_max(pattern, length(pattern)) AS pattern
  FROM addresses JOIN patterns ON regexp_matches(host || path, form, 's')
  GROUP BY row)
SELECT page_id, host, path, best.rule AS rule,
  CASE WHEN best IS NULL THEN pattern END AS pattern,
  coalesce(best.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM addresses LEFT JOIN ruled USING (row) LEFT JOIN shaped USING (row)"""

ORACLE = {
    "op1_decontamination": DECONTAMINATION,
    "op8_vector_join": VECTORS,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_sharding": SHARDING,
    "op13_url_filters": URLS,
}
