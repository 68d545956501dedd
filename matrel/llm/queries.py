"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matrel.llm.bpe import op6_bpe
from matrel.llm.chat import op7_chat_formatting
from matrel.llm.embeddings import op4_embedding_near_dedup
from matrel.llm.fingerprints import op1_document_fingerprints
from matrel.llm.lines import op2_line_dedup
from matrel.llm.minhash import op3_minhash_near_dedup
from matrel.llm.packing import op9_best_fit_packing
from matrel.llm.quality import op8_quality
from matrel.llm.token_counts import op10_token_counts
from matrel.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality": op8_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
}

#: Components of links ``l (a, b)``: the least id reachable from each node, itself included.
_REACHED = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reached(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM reached r JOIN e ON e.a = r.id), found AS (SELECT id, min(c) AS c FROM reached GROUP BY id)"

_NEAR_TEXTS = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))] ELSE list_distinct([hash(array_to_string(w[k : k + 4], ' ')) for k in range(1, len(w) - 3)]) END AS s FROM words),
x AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM x JOIN x y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (n + m - k)), {_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN found ON id = doc_id
"""

_NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(z AS DOUBLE) for z in embedding] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([z for z in embedding if z IS NULL OR NOT isfinite(z)]) = 0 AND len([z for z in embedding if z <> 0]) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93), {_REACHED},
links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN found ON id = vec_id LEFT JOIN links ON links.a = vec_id
"""

_CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

#: By brute force in SQL. The other operators hash, learn or tokenize in ways that SQL can't express.
ORACLE_SQL: dict[str, str] = {"op3_minhash_near_dedup": _NEAR_TEXTS, "op4_embedding_near_dedup": _NEAR_VECTORS, "op7_chat_formatting": _CHATS}
