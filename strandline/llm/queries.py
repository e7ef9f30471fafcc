"""The queries of the problems on texts, and SQL where it can express them."""

from __future__ import annotations

from strandline.llm.bpe import token_ids
from strandline.llm.languages import language_segments, mislabelled_segments
from strandline.llm.leakage import leaked_items
from strandline.llm.near import near_duplicate_classes, near_duplicate_pairs
from strandline.llm.pairs import pair_defects, qa_pairs
from strandline.sources.tables import table

QUERIES = {
    "p4_found": lambda spark, d: near_duplicate_pairs(table(spark, d, "demo")),
    "p4_classes": lambda spark, d: near_duplicate_classes(table(spark, d, "demo")),
    "p5_found": lambda spark, d: pair_defects(qa_pairs(table(spark, d, "demo"), table(spark, d, "eval_results"))),
    "p6_ids": lambda spark, d: token_ids(table(spark, d, "documents")),
    "p7_found": lambda spark, d: leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items")),
    "p8_found": lambda spark, d: mislabelled_segments(table(spark, d, "documents")),
    "p8_segments": lambda spark, d: language_segments(table(spark, d, "documents")),
}

_GRAMS = r"""
WITH t AS (SELECT qa_id, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) AS q FROM demo),
     u AS (SELECT q, row_number() OVER (ORDER BY q) AS id FROM (SELECT DISTINCT q FROM t WHERE length(q) >= 4)),
     g AS (SELECT DISTINCT id, substr(q, k, 4) AS x FROM (SELECT id, q, unnest(range(1, length(q) - 2)) AS k FROM u)),
     n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
     l AS (SELECT b.a, b.b FROM (SELECT v.id AS a, w.id AS b, count(*) AS shared FROM g v JOIN g w ON v.x = w.x AND v.id < w.id GROUP BY ALL) b
           JOIN n na ON na.id = b.a JOIN n nb ON nb.id = b.b WHERE shared >= 0.65 * (na.n + nb.n - shared) - 1e-12),
     m AS (SELECT qa_id, id FROM t JOIN u USING (q))
"""

SQL = {
    "p4_found": _GRAMS + """
SELECT least(x.qa_id, y.qa_id) AS qa_id_a, greatest(x.qa_id, y.qa_id) AS qa_id_b FROM l JOIN m x ON x.id = l.a JOIN m y ON y.id = l.b
UNION ALL SELECT x.qa_id, y.qa_id FROM m x JOIN m y ON x.id = y.id AND x.qa_id < y.qa_id
""",
    "p4_classes": _GRAMS + """
SELECT qa_id, min(qa_id) OVER (PARTITION BY m.id) AS class_id, coalesce(c.n, 0) AS n_links
FROM m LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id) c ON c.id = m.id
""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
     i AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM heldout_items),
     ds AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12),
     s AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id
FROM (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM ds) JOIN (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM s) USING (g)
""",
}
