"""Check SQL of the bound queries, for DuckDB."""

from __future__ import annotations

from debtscope.llm.quality_rules import BOILERPLATE

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"'[^\x20\x09-\x0D]+'"
#: A-Z to a-z only.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {pattern}))"


OP2 = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
sized AS (
  SELECT *, {_count("text", r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'")} + 4 AS tokens,
    24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
      + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM given
),
led AS (SELECT *, nth = 1 AND role = 'system' AS lead FROM sized),
sys AS (SELECT conv_id, tokens AS st, chars AS sc FROM led WHERE lead),
placed AS (
  SELECT l.*, sc, greatest(1024 - coalesce(st, 0), 1) AS room,
    sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY l.conv_id ORDER BY nth) AS upto
  FROM led l LEFT JOIN sys USING (conv_id)
),
cells AS (SELECT *, upto - tokens AS begins, (upto - tokens) // greatest(room - 256, 1) AS cell FROM placed WHERE NOT lead),
windows AS (SELECT *, cell * 2 + (upto > (cell + 1) * greatest(room - 256, 1))::INT AS win FROM cells),
heads AS (
  SELECT conv_id, win, any_value(sc) AS sc, min(begins) AS first, greatest(least(256, max(room) - (max(upto) - min(begins))), 0) AS reach,
    sum(chars) AS chars
  FROM windows GROUP BY conv_id, win
),
again AS (
  SELECT h.conv_id, h.win, sum(w.chars) AS chars FROM heads h JOIN windows w
  ON h.conv_id = w.conv_id AND w.upto <= h.first AND w.begins >= h.first - h.reach GROUP BY ALL
),
lone AS (SELECT conv_id, sc FROM sys WHERE conv_id NOT IN (SELECT conv_id FROM heads)),
written AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars + coalesce(sc, 0) AS chars FROM heads UNION ALL SELECT conv_id, chars FROM again UNION ALL SELECT conv_id, sc FROM lone
  ) GROUP BY conv_id
),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '') AS loss
  FROM led GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars AS formatted_chars
FROM said JOIN written USING (conv_id)
"""


def _num(digest: str) -> str:
    return f"('0x' || substr({digest}, 1, 8))::BIGINT"


OP3 = f"""
WITH sizes AS (SELECT doc_id, source, {_count("coalesce(text, '')", WORD)}::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes GROUP BY source
),
weighed AS (SELECT *, ((nth - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS whole FROM per),
levels AS (
  SELECT *, row_number() OVER by_level AS rank,
    (whole - coalesce(sum(cap) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW by_level AS (ORDER BY cap / w, nth)
),
reached AS (SELECT min(rank) AS r, arg_min(level, rank) AS reached_at FROM levels WHERE level <= cap / w),
targets AS (
  SELECT source, source_size, nth, CASE WHEN rank < r THEN cap ELSE least(cap, w * reached_at) END AS target, round(whole / 16)::BIGINT AS seats
  FROM levels, reached
),
won AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, nth) AS place, seats
    FROM (SELECT *, unnest(range(1, seats + 1)) AS k FROM targets)
  ) WHERE place <= seats GROUP BY source
),
sources AS (
  SELECT t.*, coalesce(quota, 0) AS quota, greatest(ceil(source_size / 1000000)::BIGINT, 1) AS shards
  FROM targets t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source
),
placed AS (
  SELECT s.*, t.source_size, t.target, t.quota, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS pos,
    {_num("md5('7:' || coalesce(doc_id::VARCHAR, ''))")} % shards AS shard
  FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source
),
shards AS (SELECT source, shard, sum(size)::BIGINT AS size, max(quota) AS quota FROM placed GROUP BY source, shard),
given AS (
  SELECT source, shard, count(*) AS blocks FROM (
    SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY size / (2 * k - 1) DESC, shard) AS place
    FROM (SELECT *, unnest(range(1, quota + 1)) AS k FROM shards)
  ) WHERE place <= quota GROUP BY source, shard
),
wanted AS (
  SELECT s.source, s.shard, s.size, least(coalesce(blocks, 0) * 16, 3 * s.size) AS want, greatest(ceil(s.size / 16)::BIGINT, 1) AS n
  FROM shards s LEFT JOIN given g ON s.source IS NOT DISTINCT FROM g.source AND s.shard = g.shard
),
chosen AS (
  SELECT *, least(round((want - passes * size) / 16)::BIGINT, n) AS rest,
    {_num("md5('7:' || coalesce(source, '') || ':' || shard)")} % n AS start
  FROM (SELECT *, CASE WHEN size > 0 THEN want // size ELSE 0 END AS passes FROM wanted)
),
ended AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM placed
),
words AS (
  SELECT doc_id, p.size, source_size, target, passes, e, n, rest, start, e - p.size AS b
  FROM ended p JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source AND p.shard = c.shard
)
SELECT doc_id, size, source_size, target, (passes * size
    + ((e // 16) * rest + start) // n * 16 + (((e // 16 + 1) * rest + start) // n - ((e // 16) * rest + start) // n) * (e % 16)
    - ((b // 16) * rest + start) // n * 16 - (((b // 16 + 1) * rest + start) // n - ((b // 16) * rest + start) // n) * (b % 16))::BIGINT AS taken
FROM words
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, unnest(range(8)) AS k FROM rep) GROUP BY doc_id),
lines AS (
  SELECT doc_id, x, {_count("x", WORD)} AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
),
judged AS (
  SELECT *, {_count("x", "'!!'")} >= 2 OR {_count("x", "'[#*$%&|<>]+'")} * 10 >= greatest(n, 10) OR {_count("x", "'[|»›]'")} >= 3
    OR (n > 30 AND NOT regexp_matches(trim(x, {WHITE}), '[.!?:;,…"''”’»)\]]$'))
    OR {" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)} AS bad
  FROM lines
),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS dups, count(*) FILTER (bad) AS bad,
    coalesce(sum(length(x)) FILTER (bad), 0) / sum(length(x)) AS lost FROM judged GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, len(ws) AS n_words, length(coalesce(array_to_string(ws, ''), '')) AS word_chars, {_count("t", "'[#*$%&|<>]'")} AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(bad, 0) AS n_bad_lines, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN by_line USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.3 AS kept
FROM base
"""

OP9 = rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
sized AS (SELECT item, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0),
known AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
wins AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM known))
),
hits AS (SELECT doc_id, k, i, item FROM wins JOIN known USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(k)) AS j FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(w.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words w USING (doc_id) LEFT JOIN names m USING (doc_id)
"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {WHITE})")} AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM shared)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM shared)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

OP11 = """
WITH units AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM units a JOIN units b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
likes AS (SELECT * FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, p.other_id AS positive_id,
  row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM likes p JOIN scores s USING (anchor_id)
WHERE NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS t(size))
),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
often AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut c JOIN often h ON c.lang = h.lang AND c.head = h.phrase JOIN often r ON c.lang = r.lang AND c.rest = r.phrase
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
),
longer AS (
  SELECT lang, part, max(a) AS more
  FROM (SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS part FROM (SELECT *, unnest([1, 2]) AS i FROM often WHERE size = 3))
  GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored s JOIN total USING (lang) LEFT JOIN longer g ON s.lang = g.lang AND s.phrase = g.part
WHERE coalesce(100 * more, 0) < 50 * a
QUALIFY rank <= 2000
"""

ORACLES = {
    "op2_chat_windows": OP2,
    "op3_mix_sources": OP3,
    "op6_quality_rules": OP6,
    "op9_benchmark_leaks": OP9,
    "op10_line_dedup": OP10,
    "op11_hard_negatives": OP11,
    "op13_phrases": OP13,
}
