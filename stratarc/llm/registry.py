"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name to module and function.
QUERIES = {
    "op1_mixing": ("stratarc.llm.mixing", "op1_mixing"),
    "op2_token_binary": ("stratarc.llm.token_binary", "op2_token_binary"),
    "op3_chat_format": ("stratarc.llm.chat", "op3_chat_format"),
    "op4_secret_scan": ("stratarc.llm.secrets_scan", "op4_secret_scan"),
    "op5_exact_dedup": ("stratarc.llm.exact_dedup", "op5_exact_dedup"),
    "op6_lm_scoring": ("stratarc.llm.lm_scoring", "op6_lm_scoring"),
    "op7_quality": ("stratarc.llm.quality", "op7_quality"),
    "op8_minhash": ("stratarc.llm.minhash", "op8_minhash"),
    "op9_topk": ("stratarc.llm.topk", "op9_topk"),
    "op10_packing": ("stratarc.llm.packing", "op10_packing"),
    "pipeline": ("corpus_pipeline", "run"),
}

_SIZES = r"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS rank FROM sized GROUP BY src),
capped AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources),
ordered AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM capped WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, least(cap, w * first(level) OVER (ORDER BY CASE WHEN level <= ratio THEN 0 ELSE 1 END, ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target
  FROM ordered),
placed AS (
  SELECT s.*, l.rank, l.source_size, l.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.src ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    coalesce(floor(l.target / nullif(l.source_size, 0)), 0) AS passes
  FROM sized s JOIN leveled l USING (src)),
mixed AS (
  SELECT *, CAST(passes + CASE WHEN start + size / 2.0::DOUBLE < target - passes * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed)
"""
_SHARE = "coalesce(least((start + size / 2.0::DOUBLE) / nullif(target, 0), 1.0::DOUBLE), 0.0::DOUBLE)"
_POSITION = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE rank % 3
  WHEN 0 THEN (sqrt(36.0::DOUBLE + -4.0::DOUBLE * ({_SHARE} * 5.0::DOUBLE)) - 6.0::DOUBLE) / -2.0::DOUBLE
  WHEN 1 THEN ({_SHARE} * 2.0::DOUBLE) / 2.0::DOUBLE
  ELSE sqrt(0.25::DOUBLE + 2.0::DOUBLE * {_SHARE}) - 0.5::DOUBLE END))"""

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLES = {
    "op1_mixing": f"""WITH {_SIZES}
SELECT doc_id, size, source_size, target, copies * size AS taken, CASE WHEN copies > 0 THEN {_POSITION} END AS position FROM mixed""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, CASE WHEN regexp_matches(text || chr(10), '(^|[^\\])</turn>\n') OR regexp_matches(text, '\\(</turn>|###)')
    THEN len(regexp_extract_all(text, '</turn>|###')) ELSE 0 END AS more FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(role) + length(text) + more + 15) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)""",
}


def queries() -> dict:
    return {k: getattr(import_module(m), f) for k, (m, f) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    pipeline = import_module("corpus_pipeline").ORACLE_SQL
    return dict(ORACLES) | ({"pipeline": pipeline} if pipeline else {})
