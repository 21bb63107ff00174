"""DuckDB oracles of the queries that SQL can express, from the operators' definitions."""

from __future__ import annotations

from .chat import Template

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""


def repeated_words(size: int) -> str:
    """CTEs up to ``marked`` (doc_id, j, word, repeated): whether word j lies in a window that starts elsewhere too."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS j FROM t),
windows AS (
  SELECT doc_id, j, word, count(*) OVER ahead AS n,
         md5(string_agg(word, ' ') OVER ahead) AS w
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
counted AS (SELECT doc_id, j, word, n = {size} AND count(*) OVER (PARTITION BY n, w) > 1 AS again FROM windows),
marked AS (
  SELECT doc_id, j, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)
         AS repeated
  FROM counted)"""


OP6 = repeated_words(35) + """
SELECT t.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, count(*) FILTER (repeated) AS n, string_agg(word, ' ' ORDER BY j) FILTER (NOT repeated) AS kept
                  FROM marked GROUP BY doc_id) USING (doc_id)"""

OP7 = repeated_words(50) + """,
runs AS (
  SELECT doc_id, min(j) AS a, max(j) + 1 AS b
  FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM marked WHERE repeated)
  GROUP BY doc_id, run)
SELECT t.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated,
       coalesce(passages, '') AS passages
FROM t LEFT JOIN (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ' ' ORDER BY a) AS passages
                  FROM runs GROUP BY doc_id) USING (doc_id)"""

OP11 = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM docs),
norm AS (SELECT doc_id, 100 - 90 + ((90 * n * N_docs) // L) AS m FROM docs, total),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * N_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN norm USING (doc_id)
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w10 AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w10 AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w10 <= 10"""

OP12 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER w5 AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w5 AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w5 <= 5"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(col: str, t: Template) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for mark in t.controls:
        out = f"replace({out}, {_quoted(mark)}, {_quoted(chr(92) + mark)})"
    return out


def chat_oracle(t: Template) -> str:
    around = " ".join(f"WHEN {_quoted(r)} THEN {len(t.opens[r]) + len(t.closes[r])}" for r in t.opens)
    named = f"{sum(map(len, t.named))} + length({_escaped('role', t)})"
    trained = f"FILTER (role = {_quoted(t.loss_role)})"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) {trained}, 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) {trained}, '')) AS loss_sha256,
       CAST(sum(CASE role {around} ELSE {named} END + length({_escaped('text', t)})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


ORACLES = {"op2_rp_forest": OP2, "op6_doubling": OP6, "op7_suffix_array": OP7, "op11_lexical": OP11, "op12_gnat_negatives": OP12, "op13_chat": chat_oracle(Template())}
