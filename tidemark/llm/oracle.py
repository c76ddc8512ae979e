"""DuckDB SQL of the corpus queries that SQL can state."""

TOPK = """
WITH codes AS (
  SELECT vec_id AS id, list_reduce(list_transform(embedding[1:64], lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings
), pairs AS (
  SELECT q.id AS query_id, r.id, bit_count(xor(q.code, r.code))::BIGINT AS distance
  FROM codes q JOIN codes r ON q.id % 20 = 0 AND q.id <> r.id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank, id, distance
FROM pairs QUALIFY rank <= 10
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 7919 % 366)::INTEGER AS fetched,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:3] AS steps
  FROM pages
), keyed AS (
  SELECT page_id, url, fetched, host, unnest(list_distinct(list_concat(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))))) AS pattern
  FROM parts WHERE host <> ''
), named AS (
  SELECT pattern, min(page_id) AS f FROM keyed
  WHERE pattern = host OR len(regexp_replace(pattern, '[^/]', '', 'g')) = 1 GROUP BY pattern HAVING min(page_id) % 3 = 0
), dates AS (
  SELECT pattern, f, DATE '2024-01-01' + (f * 31 % 366)::INTEGER AS on_day,
    DATE '2024-01-01' + (f * 31 % 366)::INTEGER + (f * 17 % 90 + 1)::INTEGER AS off_day FROM named
), spans AS (
  SELECT pattern, on_day AS since, CASE WHEN f % 2 = 0 THEN off_day END AS until FROM dates
  UNION ALL SELECT pattern, off_day + 60, NULL FROM dates WHERE f % 4 = 0
), hits AS (
  SELECT k.page_id, k.pattern, s.since FROM keyed k JOIN spans s USING (pattern)
  WHERE s.since <= k.fetched AND (s.until IS NULL OR k.fetched < s.until)
  QUALIFY row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.pattern) DESC, k.pattern) = 1
)
SELECT p.page_id, p.url, p.fetched, h.pattern IS NOT NULL AS blocked, h.pattern, h.since
FROM parts p LEFT JOIN hits h USING (page_id)
"""

DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), safe AS (
  SELECT *, regexp_replace(text, '(\\*)(### (?:System|User|Assistant|Role):|</role>|</turn>)', '\1\1\\\2', 'g') AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + 9 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""

RANKED = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM sized
), item_terms AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), tfs AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM sized)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) CROSS JOIN whole
), parts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all))) AS part
  FROM tfs JOIN weights USING (term) JOIN sized USING (doc_id) CROSS JOIN whole
), scores AS (
  SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM parts JOIN item_terms USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

# CRC-32 byte by byte, of each distinct feature once: the table of the 256 remainders is worked out first
_SHIFTED = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

IMPORTANCE = rf"""
WITH RECURSIVE turns AS (
  SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, {_SHIFTED}, step + 1 FROM turns WHERE step < 8
), crcs AS (SELECT list(c ORDER BY i) AS crc FROM turns WHERE step = 8
), texts AS (
  SELECT 0 AS side, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, NULL, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))),
      lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INTEGER + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features) CROSS JOIN crcs
), placed AS (SELECT side, doc_id, bucket FROM features JOIN hashed USING (f)
), sizes AS (SELECT count(*) FILTER (WHERE side = 0) AS raw, count(*) FILTER (WHERE side = 1) AS target FROM placed
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (raw + 10000)::DOUBLE / ((s + 1)::DOUBLE * (target + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM placed GROUP BY bucket)
  CROSS JOIN sizes
), weighed AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT t.doc_id, coalesce(len(w), 0) >= 20 AS long, coalesce(n_features, 0)::BIGINT AS n_features,
    CASE WHEN n_features > 0 THEN floor(total::DOUBLE / n_features)::BIGINT ELSE 0 END AS weight,
    ('0x' || substr(sha256('7:' || t.doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM texts t LEFT JOIN weighed USING (doc_id) WHERE side = 0
), noisy AS (
  SELECT doc_id, long, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM noisy WHERE long
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 25 * (SELECT count(*) FROM noisy WHERE long) // 100 THEN place END::BIGINT AS rank
FROM noisy LEFT JOIN ranks USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op3_chat": CHAT,
    "op7_topk": TOPK,
    "op9_url_filters": URL_FILTERS,
    "op10_decontamination": DECONTAMINATION,
    "op11_ranked": RANKED,
    "op12_importance": IMPORTANCE,
}
