"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from sparkloom.llm import bpe, chat, jaccard, licenses, neardup, negatives, packing, quality, repair, secrets, suffixes, topk, warc

#: Payloads of at least 100 bytes that equal an earlier page's revisit it.
OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
     f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

#: Exact integer inner products; ties go to the smaller vec_id.
OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Links within a label by cosine; components by following links as far as they go.
OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     sound AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
     links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
               WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
     n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""

#: Every anchor against all rows, then every positive against the anchor's scores.
OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     r AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
           FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""

#: The template's marks take 23 characters a turn; a control string grows by one backslash.
OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS r2, regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS t2 FROM c),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t2) AS turns,
                  coalesce(string_agg(text, '' ORDER BY turn, role, t2) FILTER (role = 'assistant'), '') AS loss, CAST(sum(23 + length(r2) + length(t2)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0 AS n_attachments, 0 AS expanded_tokens FROM g
"""


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_chat_format": chat.op3_chat_format,
        "op4_exact_top_k": topk.op4_exact_top_k,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_warc": warc.op9_warc,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_embedding_near_dedup": neardup.op11_embedding_near_dedup,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3, "op4_exact_top_k": OP4, "op9_warc": OP9, "op11_embedding_near_dedup": OP11, "op13_hard_negatives": OP13}
