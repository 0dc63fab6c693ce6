"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .chat import rotate_perspectives
from .common import table
from .dart_minhash import near_duplicates
from .grace_dedup import grace_dedup
from .language_id import identify_language
from .lattice_lm import score_documents
from .line_dedup import dedup_lines
from .mixing import mix
from .secrets import scan_secrets
from .spelling import group_variants
from .token_files import token_sums
from .toxicity import score_toxicity
from .winnowing import decontaminate


def op1_lattice_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op2_winnowing(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_secrets(spark, sf_dir):
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op6_perspectives(spark, sf_dir):
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


def op8_dart_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_grace_dedup(spark, sf_dir):
    return grace_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark, sf_dir):
    return group_variants(table(spark, sf_dir, "documents"))


def op12_token_files(spark, sf_dir):
    return token_sums(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lattice_lm, op2_winnowing, op3_secrets, op4_line_dedup, op5_mixing, op6_perspectives,
    op7_language_id, op8_dart_minhash, op9_grace_dedup, op10_toxicity, op11_spelling, op12_token_files,
    op13_alignment,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE_SQL = {
    "op2_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i AS pos, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.pos, g.n, k.item_id FROM g JOIN k USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op6_perspectives": """
WITH c AS (SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq FROM c),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM c),
r AS (SELECT s.*, perspective, CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || role || '|>' || chr(10) END AS head FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM r)
SELECT conv_id, perspective, seq, turn, role AS speaker, head || text || chr(10) AS text, place + length(head) AS body_start, place + length(head) + length(text) AS body_end, role = perspective AS learn FROM o""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
c AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, (c.k IS NOT NULL AND l.doc_id <> c.holder) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op9_grace_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
}
