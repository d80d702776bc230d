"""The queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

JUMP_SHARDING = """
WITH RECURSIVE crc_table AS (
  WITH RECURSIVE t(i, k, v) AS (
    SELECT i, 0, i::BIGINT FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM t WHERE k < 8
  )
  SELECT list(v ORDER BY i) AS steps FROM t WHERE k = 8
),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
),
summed AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8))) AS text_crc32
  FROM sized, crc_table
),
jumps(doc_id, key, spot, dest) AS (
  SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k, dest, floor((dest + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, dest, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k
        FROM jumps WHERE dest <= 40)
),
placed AS (
  SELECT doc_id, max(spot) FILTER (spot < 40)::INTEGER AS shard, max(spot)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'key' AS law, p.shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot, p.grown_shard
FROM summed s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

DECONTAMINATE = r"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT row_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM worded, sizes WHERE len(words) >= n
),
found AS (
  SELECT p.row_id, p.i, p.n, w.item_id
  FROM places p JOIN windows w ON list_slice(p.words, p.i, p.i + p.n - 1) = w.win
),
hit AS (
  SELECT row_id, count(DISTINCT k) AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT row_id, i, n FROM found)) GROUP BY row_id
),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS id FROM found) GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents
),
marked AS (
  SELECT *, doc_id::HUGEINT * 4294967296 + line_no AS place FROM lines WHERE trim(line, ' ') <> ''
),
firsts AS (SELECT line, min(place) AS place FROM marked GROUP BY line),
variants AS (
  SELECT line, place, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS variant
  FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS i FROM firsts WHERE length(line) >= 20)
),
whole AS (SELECT line, place, md5(line) AS variant FROM firsts WHERE length(line) >= 20),
near AS (
  SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY i, variant) AS other FROM variants)
  WHERE other < place
  UNION SELECT v.line FROM variants v JOIN whole w USING (variant) WHERE w.place < v.place
  UNION SELECT w.line FROM variants v JOIN whole w USING (variant) WHERE v.place < w.place
),
judged AS (
  SELECT m.doc_id, m.line_no, n.line IS NOT NULL AS near, n.line IS NULL AND m.place <> f.place AS exact
  FROM marked m JOIN firsts f USING (line) LEFT JOIN near n USING (line)
),
summed AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(exact OR near, false)), '') AS kept
  FROM lines l LEFT JOIN judged j USING (doc_id, line_no) GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_exact, n_near, sha256(kept) AS kept_sha256 FROM summed
"""

TOPK_SEARCH = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
),
spelled AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hexed, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest
  FROM payloads
),
firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM spelled
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM firsts
"""

RANKED_SEARCH = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
sized AS (SELECT r, doc_id, len(words)::BIGINT AS n, words FROM worded WHERE len(words) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(list_sort(list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')))) AS term
  FROM benchmark
),
counted AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
),
gains AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))) AS gain
  FROM counted JOIN weighed USING (term) JOIN sized USING (r), corpus
),
scored AS (
  SELECT item_id, r, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY item_id, r HAVING sum(gain) > 0
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored JOIN sized USING (r) QUALIFY rank <= 10
"""

PERIODIC_RUNS = r"""
WITH RECURSIVE crc_table AS (
  WITH RECURSIVE t(i, k, v) AS (
    SELECT i, 0, i::BIGINT FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM t WHERE k < 8
  )
  SELECT list(v ORDER BY i) AS steps FROM t WHERE k = 8
),
worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM documents
),
hashed AS (
  SELECT r, doc_id, own, len(own)::BIGINT AS n, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8))) AS h
  FROM worded, crc_table
),
tails AS (
  SELECT r, doc_id, own, n, coalesce(h % 10 = 0, false) AND n > 0 AS planted, (h // 10) % greatest(n, 1) AS a,
    1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p
  FROM hashed
),
texts AS (
  SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i:
    CASE WHEN i < a THEN own[i + 1] ELSE own[a + (i - a) % p + 1] END) ELSE own END AS words
  FROM tails
),
words AS (SELECT r, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM texts),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
streaks AS (
  SELECT r, min(i) AS start, count(*) + q AS length, q
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (SELECT r, start, length, min(q) AS period FROM streaks GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (r, i) GROUP BY r
),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS top
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length,
  top.period::BIGINT AS period, ((1000 * top.length) // top.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_topk_search": TOPK_SEARCH,
    "op4_jump_sharding": JUMP_SHARDING,
    "op5_warc": WARC,
    "op10_decontaminate": DECONTAMINATE,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_exact_dedup": EXACT_DEDUP,
}
