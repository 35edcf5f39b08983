"""DuckDB twins of the registered queries, for those that SQL can express."""

ORACLES = {
    "op4_knn": """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op5_mixing": r"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS weight FROM counts),
rates AS (
    SELECT source, (weight / (SELECT sum(weight) FROM weighted)) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM weighted
),
pieces AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS pieces FROM rates),
cdf AS (
    SELECT source, pieces, rate / pieces AS part, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS c FROM pieces
    UNION ALL
    SELECT source, pieces, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM cdf WHERE k < 79
),
steps AS (SELECT source, any_value(pieces) AS pieces, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
    SELECT d.*, list_sum(list_transform(generate_series(1, pieces), lambda j: len(list_filter(cs, lambda c:
        c < (('0x' || substr(sha256('42:' || d.doc_id || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)))) AS times
    FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
),
copies AS (SELECT *, unnest(generate_series(1, times::BIGINT))::INT AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy,
       substr(sha256('order:42:' || doc_id || ':' || copy), 1, 16) AS shuffle_key
FROM copies
""",
    "op6_exact_dedup": r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
),
placed AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM placed
""",
    "op8_warc": """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM placed
""",
    "op10_chat": r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
           length(text) + length(text) - length(replace(text, '\', ''))
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0)
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 ELSE 15 END + 9 AS chars,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN before = 'user' THEN role = 'assistant'
                     ELSE role = 'user' END
                AND (following IS NOT NULL OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
""",
    "op12_repair": r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
),
hashed AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(key)), lambda i: unicode(substr(key, i::INT, 1))::BIGINT)),
        lambda c, b: list_reduce(
            list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS fault
    FROM keyed
),
damaged AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(generate_series(1, CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE fault <> 0
),
placed AS (
    SELECT *, row_number() OVER w AS k, left(role, 1) AS initial,
           lag(left(role, 1)) OVER w AS initial_before,
           trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || ':' || text), copy)
),
faulty AS (
    SELECT *, CASE WHEN visible = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                   WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed
),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
),
moves AS (
    SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS t(i, role, j)
),
insertions AS (
    SELECT i, i AS j, 0 AS cost, '' AS audit FROM range(4) AS r(i)
    UNION ALL SELECT i, j, 5, 'I' FROM moves WHERE role <> 's'
    UNION ALL SELECT a.i, b.j, 10, 'II' FROM moves a JOIN moves b ON a.j = b.i WHERE a.role <> 's' AND b.role <> 's'
),
ways AS (
    SELECT conv_id, 0::BIGINT AS k, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM counts
    UNION ALL
    SELECT conv_id, k, state, cost, audit FROM (
        SELECT conv_id, k, state, cost, audit,
               row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place
        FROM (
            SELECT w.conv_id, f.k, e.j AS state, w.cost + s.cost + e.cost AS cost, w.audit || s.audit || e.audit AS audit
            FROM ways w JOIN insertions s ON s.i = w.state
            JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
            CROSS JOIN LATERAL (
                SELECT s.j AS j, 2 AS cost, 'D' AS audit
                UNION ALL SELECT m.j, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K' FROM moves m
                    WHERE m.i = s.j AND m.role = f.initial AND f.fault NOT IN ('blank', 'duplicate')
                UNION ALL SELECT m.j, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R' FROM moves m
                    WHERE m.i = s.j AND m.role <> 's' AND f.fault NOT IN ('blank', 'duplicate')
            ) e
        )
    ) WHERE place = 1
),
ended AS (
    SELECT w.conv_id, w.cost + s.cost AS cost, w.audit || s.audit AS audit
    FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k
    JOIN insertions s ON s.i = w.state WHERE s.j IN (0, 3)
),
best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ended) WHERE place = 1
),
letters AS (
    SELECT conv_id, x, substr(audit, x::INT, 1) AS letter, length(replace(left(audit, x::INT), 'I', '')) AS k
    FROM best, LATERAL (SELECT unnest(generate_series(1, length(audit))) AS x)
),
standing AS (
    SELECT l.conv_id, l.x, l.letter, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.x) AS number,
           first_value(l.letter = 'K' AND f.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY l.x) AS system
    FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.k = l.k AND l.letter <> 'I'
    WHERE l.letter <> 'D'
),
repaired AS (
    SELECT conv_id, sha256(string_agg(
        CASE letter WHEN 'K' THEN role ELSE CASE WHEN (number + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
        || ':' || coalesce(text, ''), chr(10) ORDER BY x)) AS repaired_sha256
    FROM standing GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
