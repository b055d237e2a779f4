"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP11_SQL, op11_centroids
from .chat import op4_chat
from .codebooks import OP13_SQL, op13_codes
from .decontaminate import op5_decontaminate
from .language import op12_language
from .licenses import op2_licenses
from .mixing import OP3_SQL, op3_mixing
from .quality import op1_quality
from .sharding import op9_sharding
from .simhash import op6_simhash
from .suffixes import op10_suffixes
from .topk import op8_topk
from .toxicity import op7_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_quality": lambda s, d: op1_quality(t(s, d, "documents"), t(s, d, "labels")),
        "op2_licenses": lambda s, d: op2_licenses(t(s, d, "documents")),
        "op3_mixing": lambda s, d: op3_mixing(t(s, d, "documents")),
        "op4_chat": lambda s, d: op4_chat(t(s, d, "conversations")),
        "op5_decontaminate": lambda s, d: op5_decontaminate(t(s, d, "documents"), t(s, d, "benchmark")),
        "op6_simhash": lambda s, d: op6_simhash(t(s, d, "documents")),
        "op7_toxicity": lambda s, d: op7_toxicity(t(s, d, "documents"), t(s, d, "labels")),
        "op8_topk": lambda s, d: op8_topk(t(s, d, "embeddings")),
        "op9_sharding": lambda s, d: op9_sharding(t(s, d, "documents")),
        "op10_suffixes": lambda s, d: op10_suffixes(t(s, d, "documents")),
        "op11_centroids": lambda s, d: op11_centroids(t(s, d, "embeddings")),
        "op12_language": lambda s, d: op12_language(t(s, d, "documents")),
        "op13_codes": lambda s, d: op13_codes(t(s, d, "embeddings")),
    }


#: Exact: every distance between the codes, all rows against the stated queries.
OP8_SQL = """
WITH c AS (SELECT DISTINCT vec_id AS id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (SELECT q.id AS query_id, r.id AS neighbor_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM c q JOIN c r ON q.id % 100 = 0 AND q.id <> r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM k WHERE rank <= 10
"""

#: Every place of every item (of ten words or more, as all given ones are) in every document, every stretch of each.
OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p, len(w) AS n FROM dw), y AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS q, len(w) AS k FROM iw),
a AS (SELECT doc_id, item_id, p - q AS shift, any_value(k) AS k, any_value(n) AS n, list(q) AS qs FROM x JOIN y ON x.t = y.t GROUP BY 1, 2, 3 HAVING count(*) >= least(12, ceil(any_value(k) * 0.8))),
e AS (SELECT doc_id, item_id, shift, k, unnest(qs) AS q FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS r FROM e),
s AS (SELECT u.doc_id, u.item_id, u.k, v.r - u.r + 1 AS same, v.q - u.q + 1 AS size FROM r u JOIN r v ON u.doc_id = v.doc_id AND u.item_id = v.item_id AND u.shift = v.shift AND v.r >= u.r),
o AS (SELECT doc_id, item_id, max(same)::INTEGER AS overlap FROM s WHERE 5 * same > 4 * size GROUP BY 1, 2 HAVING max(same) >= least(12, ceil(any_value(k) * 0.8)))
SELECT doc_id, count(DISTINCT item_id) AS n_items, max(overlap) AS overlap, arg_min(item_id, (-overlap)::BIGINT * 1000000000 + item_id) AS item_id FROM o GROUP BY 1
"""

#: Every window of every document, in hexadecimal.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
w AS (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM b),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM w),
m AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
late AS (SELECT g.doc_id, g.i FROM g JOIN m ON m.g = g.g WHERE g.doc_id > m.lo),
isl AS (SELECT *, CASE WHEN i > lag(i) OVER p + 50 THEN 1 ELSE 0 END AS new FROM late WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
num AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM isl),
sp AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM num GROUP BY doc_id, grp),
seg AS (SELECT sp.*, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM sp),
k AS (SELECT seg.doc_id, sum(e - s)::BIGINT AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(b.h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head FROM seg JOIN b ON b.doc_id = seg.doc_id GROUP BY 1)
SELECT b.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN k ON k.doc_id = b.doc_id
"""

#: Digests from the turns themselves, and the windows' lengths by the same prefix sums.
OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
b AS (SELECT *, '<|turn|>' || regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') || '<|body|>'
  || regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') || '<|end|>' AS b, pos = 1 AND role = 'system' AS sys FROM t),
k AS (SELECT *, length(b)::BIGINT AS n, len(regexp_extract_all(b, '\p{L}{1,5}|\p{N}{1,3}|[^\s\x0B\p{L}\p{N}]'))::BIGINT AS cost FROM b),
o AS (SELECT *, CASE WHEN sys THEN 0 ELSE cost END AS own FROM k),
p AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT AS e, (2048 - sum(CASE WHEN sys THEN cost ELSE 0 END) OVER (PARTITION BY conv_id))::BIGINT AS room, max(own) OVER (PARTITION BY conv_id) AS most FROM o),
q AS (SELECT *, e - own AS start, most * 2 <= room - 256 AS small, greatest(CASE WHEN most * 2 <= room - 256 THEN room - 256 - most ELSE room - 256 END, 1) AS pitch FROM p),
r AS (SELECT *, (start // pitch) * 2 + CASE WHEN NOT small AND greatest(e - 1, start) // pitch > start // pitch THEN 1 ELSE 0 END AS win FROM q),
w AS (SELECT conv_id, win, min(start) AS s, least(256, any_value(room) - sum(own)) AS allow, bool_or(sys) AS own_head FROM r GROUP BY 1, 2),
x AS (SELECT *, lead(s) OVER z AS next_s, lead(allow) OVER z AS next_allow FROM w WINDOW z AS (PARTITION BY conv_id ORDER BY win)),
again AS (SELECT r.conv_id, sum(r.n) AS n FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.win = r.win WHERE NOT r.sys AND x.next_s IS NOT NULL AND x.next_s - r.start <= x.next_allow GROUP BY 1),
head AS (SELECT conv_id, count(*) FILTER (WHERE NOT own_head) AS windows FROM w GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss,
  sum(n) AS n, coalesce(sum(CASE WHEN sys THEN n END), 0) AS head FROM r GROUP BY 1)
SELECT g.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (g.n + coalesce(a.n, 0) + g.head * h.windows)::BIGINT AS formatted_chars
FROM g LEFT JOIN again a ON a.conv_id IS NOT DISTINCT FROM g.conv_id JOIN head h ON h.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op3_mixing": OP3_SQL, "op5_decontaminate": OP5_SQL, "op8_topk": OP8_SQL, "op10_suffixes": OP10_SQL, "op11_centroids": OP11_SQL, "op13_codes": OP13_SQL}
