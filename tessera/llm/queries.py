"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat import OP8_SQL, op8_chat
from .decontaminate import op4_decontaminate
from .html import op1_html
from .neighbours import op9_neighbours
from .pii import op5_pii
from .quality import op2_quality
from .sharding import op6_sharding
from .simhash import op10_simhash
from .toxicity import op7_toxicity

_words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_words} AS w FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_words} AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
windows AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM tests) AS sizes WHERE len(w) >= n)
),
met AS (SELECT windows.rid, windows.i, windows.n, tests.item_id FROM windows JOIN tests ON windows.n = tests.n AND windows.t = tests.t),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

QUERIES = {
    "op1_html": op1_html,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_neighbours": op9_neighbours,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL = {"op4_decontaminate": OP4_SQL, "op8_chat": OP8_SQL}
