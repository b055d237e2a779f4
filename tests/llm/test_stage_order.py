"""Stages give the same rows however ids repeat, rows are partitioned and columns are named."""

import pytest
from pyspark.sql import functions as F

from epochal.llm.decontaminate import decontaminate_stage
from epochal.llm.mixing import mix_stage
from epochal.llm.sharding import shard_stage
from epochal.llm.simhash import dedup_stage


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids used twice, with other texts of one size, and with one text in rows that differ elsewhere."""
    rows = [(i % 40, f"word{i:03d} and more{i % 7} of it", "en", f"s{i % 3}", i) for i in range(160)]
    rows += [(i, f"same words here {i}", lang, "s0", 1) for i in range(12) for lang in ("en", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_is_the_same_over_partitions(repeated):
    mixes = [sorted(map(tuple, mix_stage(repeated.repartition(n, "n_chars")).collect())) for n in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2] and len(mixes[0]) > 0


def test_any_column_names(spark, repeated):
    odd = repeated.withColumns({"a.b": F.col("n_chars") + 1, "c`d": F.lit("x"), "row": F.lit(0), "_row": F.lit(1), "row.text": F.lit("y")})
    bench = spark.createDataFrame([(1, " ".join(f"test{i}" for i in range(20)))], "item_id long, text string")
    for stage in (mix_stage, dedup_stage, lambda d: decontaminate_stage(d, bench), shard_stage):
        out = stage(odd)
        assert set(odd.columns) <= set(out.columns)
        assert out.where("`a.b` <> n_chars + 1 OR `c``d` <> 'x' OR `row.text` <> 'y'").count() == 0 < out.count()
