"""DuckDB SQL for the operators that SQL can express."""

_JUMP_SHARDS = """
WITH RECURSIVE table_steps AS (
    SELECT i AS byte, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) t(i)
    UNION ALL SELECT byte, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM table_steps WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY byte) AS t FROM table_steps WHERE step = 8),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
    SELECT doc_id, strlen(text) + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS BIGINT)) AS bytes, t FROM texts, crc_table
), rows AS (
    SELECT doc_id, CAST(size AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1])), 4294967295) AS crc FROM sized
), hops AS (
    SELECT doc_id, n, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS k
    FROM (SELECT DISTINCT doc_id FROM documents) d, (VALUES (16), (17)) s(n)
    UNION ALL
    SELECT doc_id, n, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0 / CAST(nk // 8589934592 + 1 AS DOUBLE))) AS BIGINT), nk
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM hops WHERE j < n) x
), landed AS (SELECT doc_id, CAST(max(CASE WHEN n = 16 THEN b END) AS INT) AS shard, CAST(max(CASE WHEN n = 17 THEN b END) AS INT) AS grown_shard FROM hops WHERE j >= n GROUP BY doc_id)
SELECT r.doc_id, r.size, CAST(r.crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
    CAST(row_number() OVER (PARTITION BY shard ORDER BY ((r.doc_id % 1021) + 1021) % 1021, r.doc_id, r.crc, r.size) - 1 AS BIGINT) AS slot, grown_shard
FROM rows r JOIN landed l ON l.doc_id = r.doc_id
"""

_NEAR_PAIRS = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
steps AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS r FROM sets UNION SELECT s.y, r.r FROM reach r JOIN steps s ON s.x = r.x AND r.r < s.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(min(r.r) AS BIGINT) AS component_id, min(r.r) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

ORACLES = {"op8_jump_sharding": _JUMP_SHARDS, "op9_minhash": _NEAR_PAIRS}
