"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'),
                           '\[(/?INST\])', '[\\\1', 'g') AS body FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""

SEARCH = """
WITH c AS (
  SELECT vec_id, list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END),
                             lambda a, b: a * 2 + b) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
r AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
  FROM (SELECT * FROM c WHERE vec_id % 100 = 0) q JOIN c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM r WHERE rank <= 10
"""

LLM_ORACLE: dict[str, str] = {"op3_hamming_search": SEARCH, "op7_warc_conversion": WARC, "op8_chat_formatting": CHAT}
