"""The queries opN_<name> over whole tables, and their SQL where SQL can express them.

A query's module is imported when it runs."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query: module of this package; the function there has the query's name
_MODULES = {
    "op1_piece_dropout": "pieces",
    "op2_quality_classifier": "quality",
    "op3_jaccard_join": "jaccard",
    "op4_language_id": "language",
    "op5_suffix_dedup": "repeats",
    "op6_vector_links": "vectors",
    "op7_token_store": "token_store",
    "op8_line_rules": "line_rules",
    "op9_packing": "packing",
    "op10_html_text": "html_text",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(importlib.import_module(f"ticklake.llm.{_MODULES[name]}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _MODULES}


#: All pairs of n-gram sets, and what their links reach.
_JACCARD = r"""
WITH RECURSIVE folded AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS x FROM documents),
words AS (SELECT doc_id, string_split(x, ' ') AS w FROM folded WHERE x <> ''),
gram AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= CAST(0.8 AS DOUBLE)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM documents JOIN least USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

#: All pairs of vectors by cosine, and what their links reach.
_COSINE = """
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT vec_id, v FROM given WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    """Learned scores, tokens, packed places and inferred wrappers are beyond SQL; the two
    joins are not."""
    return {"op3_jaccard_join": _JACCARD, "op6_vector_links": _COSINE}
