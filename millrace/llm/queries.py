"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import bpe, extract, imatch, lm, media, mixing, neardup, quality, secrets, sharding

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op5_lm": lm.op5_lm,
    "op2_quality": quality.op2_quality,
    "op1_near_dedup": neardup.op1_near_dedup,
    "op3_html": extract.op3_html,
    "op6_fingerprints": imatch.op6_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op10_media": media.op10_media,
    "op4_secrets": secrets.op4_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op9_bpe": bpe.op9_bpe,
}

#: Near-duplicate components: all pairs that share a shingle, then reachability.
_NEAR = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingle AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END)) AS s FROM cut
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM met JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), reach AS (
  SELECT doc_id AS root, doc_id AS id FROM documents UNION SELECT root, b FROM reach JOIN link ON id = a
), least AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sized ON sized.doc_id = d.doc_id
"""

#: The others learn, use hashes that SQL lacks, or search: they have brute-force tests.
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": _NEAR}
