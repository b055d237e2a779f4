"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  Expected copies
are prefix-summed over the source's documents in order of size, a random offset is
added, and a copy is emitted for every whole number crossed, so each document gets
the floor or the ceiling of its expectation and a source's words come within about
one document of its target.  Ranks come from three levels of pre-aggregated counts
(size class, hash bucket, row), so that no task holds a whole source.

Sizes are counted once and written, narrow; counts come from that table.

Null source: a source of its own, last.  Null or empty text: size 0.  A source
without words has target 0 and gives no copies.  Repeated rows count each.  An empty table gives no rows.
A row travels as one struct, so its columns may have any names and keep their values.  Rows stand in order of size, hash of
doc_id, doc_id, text and whole row (the last two by hash), so that reruns agree however ids repeat and rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_row

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(_null, _src, source_size, target) from one row (_null, _src, source_size) a source.

    Sources by code point, null last, weigh ``weights`` in turn; a target stops at
    ``cap`` times its source's size and the excess is shared again by weight.  That is
    filling with a common level L: target = min(w L, cap size); L is found by sorting
    sources by cap size / w.  One row a source goes through one task here.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy("_null", "_src")) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w.cast("long")).withColumn("_full", F.col("source_size") * cap)
    t = t.withColumn("_c", F.col("_full") / F.col("_w"))
    o = Window.orderBy("_c", "_null", "_src")
    done = o.rowsBetween(Window.unboundedPreceding, -1)
    rest = o.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumns(
        {
            "_level": (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_full").over(done), F.lit(0)))
            / (F.sum("_w").over(Window.partitionBy()) - F.coalesce(F.sum("_w").over(done), F.lit(0))),
        }
    )
    level = F.max(F.when(F.col("_level") <= F.col("_c"), F.col("_level"))).over(Window.partitionBy())
    t = t.withColumn("_l", level)
    return t.select(
        "_null", "_src", "source_size",
        F.when(F.col("_c") <= F.col("_l"), F.col("_full").cast("double")).otherwise(F.col("_w") * F.col("_l")).alias("target"),
    )


def placed(row, size, doc_id="doc_id", source="source", seed: str = "mix") -> list:
    """Columns that say where a row stands: its source, size class, hash bucket and key; and the row itself."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    # size class: exact below 32, then steps of 1/16 of the size
    level = (shift * 32 + F.call_function("shiftright", size, shift)).cast("int")
    return [
        F.col(source).isNull().alias("_null"), F.coalesce(F.col(source), F.lit("")).alias("_src"), level.alias("_class"), F.substring(key, 1, 2).alias("_bucket"),
        key.alias("_key"), F.col(doc_id).alias("_id"), size.alias("size"), row.alias("row"),
    ]


def firsts(narrow: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """For each (source, class, bucket): the rows before it in its source, and the source's size and target."""
    cells = narrow.groupBy("_null", "_src", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    classes = cells.groupBy("_null", "_src", "_class").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    by_class = Window.partitionBy("_null", "_src").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy("_null", "_src", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select("_null", "_src", "_class", F.coalesce(F.sum("_n").over(by_class), F.lit(0)).alias("_above"))
    sources = targets(classes.groupBy("_null", "_src").agg(F.sum("_s").alias("source_size")), weights, cap)
    return (
        cells.select("_null", "_src", "_class", "_bucket", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_before"))
        .join(starts, ["_null", "_src", "_class"])
        .join(sources, ["_null", "_src"])
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", whole: bool = True) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs`` as a struct, and how often the mix takes it.

    Without ``whole`` the row is (doc_id) alone, and texts are read once."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    counted = materialise(docs.select("doc_id", "source", size.alias("size")), "sizes")
    narrow = counted.select(*placed(F.struct("doc_id"), F.col("size"), seed=seed))
    rows = docs.select(*placed(whole_row(docs), size, seed=seed)) if whole else narrow
    # Rows of one id and size are told apart by their text, then by all else they hold, so that reruns take the same ones.
    ties = [F.xxhash64("row.text"), F.xxhash64(F.to_json("row"))] if whole else []
    rank = F.row_number().over(Window.partitionBy("_null", "_src", "_class", "_bucket").orderBy("size", "_key", "_id", *ties))
    # The offset: 20 bits of a hash of the source, so that sums with it stay exact.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src"), F.col("_null").cast("string")).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = rows.withColumn("_rank", rank).join(firsts(narrow, weights, cap), ["_null", "_src", "_class", "_bucket"])
    at = F.col("_above") + F.col("_before") + F.col("_rank")
    crossed = F.floor(at * ratio + offset) - F.floor((at - 1) * ratio + offset)
    return out.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def op3_mixing(docs: DataFrame) -> DataFrame:
    """Digest: words each document gives to the mix."""
    m = mix(docs, whole=False)
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, with all the input's columns."""
    taken = mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


#: The same in DuckDB.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k, source IS NULL AS nul, coalesce(source, '') AS src FROM documents),
e AS (SELECT *, greatest(length(bin(size)) - 5, 0) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS cl FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY nul, src ORDER BY cl, substr(k, 1, 2), size, k, doc_id) AS rnk FROM e),
s AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::BIGINT AS w FROM s),
c AS (SELECT *, (source_size * 3)::DOUBLE / w AS c FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(source_size * 3) OVER (ORDER BY c, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
  / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER (ORDER BY c, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS lv FROM c),
t AS (SELECT nul, src, source_size, CASE WHEN c <= lev THEN (source_size * 3)::DOUBLE ELSE w * lev END AS target
  FROM (SELECT *, max(CASE WHEN lv <= c THEN lv END) OVER () AS lev FROM l)),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rnk, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
  ('0x' || substr(md5('mix' || r.src || CASE WHEN r.nul THEN 'true' ELSE 'false' END), 1, 5))::BIGINT::DOUBLE / 1048576 AS o
  FROM r JOIN t ON r.nul = t.nul AND r.src = t.src)
SELECT doc_id, size, source_size, target, ((floor(rnk * ratio + o) - floor((rnk - 1) * ratio + o))::BIGINT * size) AS taken FROM x
"""
