"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from sedge.llm import ann, bpe, fingerprint, html_text, neardup, packing, quality, sharding, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html": html_text.op2_html,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_bpe": bpe.op6_bpe,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_neardup": neardup.op8_neardup,
        "op9_nearest": ann.op9_nearest,
        "op10_packing": packing.op10_packing,
    }


#: Links of op8 on full shingle sets, and the smallest doc_id that they lead to.
_NEARDUP = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, two_way.b FROM reach JOIN two_way ON two_way.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) m ON m.v = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_neardup": _NEARDUP}
