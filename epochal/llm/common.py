"""Shared plumbing: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset
    and driver and executors are one process (an error on a cluster)."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="epochal-")
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/epochal-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._epochal_path = path
    return out


def append(df: DataFrame, to: DataFrame | None, tag: str) -> DataFrame:
    """Like :func:`materialise`, or into the table ``to`` that an earlier call made."""
    path = getattr(to, "_epochal_path", None)
    if path is None:
        return materialise(df, tag)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._epochal_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise` that nothing will read again."""
    path = getattr(df, "_epochal_path", None)
    if path:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)


def whole_row(df: DataFrame):
    """All columns of ``df`` as one struct, whatever their names hold (dots, backticks)."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, and Spark's cleaner a second to delete the shuffle files of plans that are done
    with; else they stay until it happens to."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def bounded(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of at most ``limit`` bytes for the whole session, the same for every operator (rows are left as they
    are set): what Spark and its Python workers hold of texts at a time is bounded, however long they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") != str(limit):
        spark.conf.set(key, str(limit))


def small(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes (one row at least): memory is bounded by bytes,
    whatever the session's batch settings are."""
    for b in batches:
        if b.nbytes <= limit or b.num_rows < 2:
            yield b
            continue
        sizes = np.full(b.num_rows, 16, np.int64)
        for c in b.columns:
            if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [b.num_rows]))
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield b.slice(s, e - s)


def bitmap(found: DataFrame, most: int = 28) -> tuple[np.ndarray, int]:
    """(bits, log_bits): a bitmap of the leading bits of ``seed``, packed, least bit first.  It has sixteen places a value
    or more, and 2**``most`` at most (32 MB; past it more of what it is asked for passes, and nothing is lost)."""
    n = found.count()
    log_bits = min(most, max(20, int(16 * n).bit_length()))
    slot = F.shiftrightunsigned("seed", 64 - log_bits)
    words = (
        found.select(F.shiftrightunsigned(slot, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8), log_bits


def passes(bits: np.ndarray, log_bits: int, seed: np.ndarray) -> np.ndarray:
    """Which seeds (unsigned) a bitmap lets pass."""
    slot = (seed >> np.uint64(64 - log_bits)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _contract(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), ``most`` at a time, as stars: each node with the smallest it reaches among them."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            then = root.copy()
            np.minimum.at(then, a, low)
            np.minimum.at(then, b, low)
            np.minimum.at(then, root[a], low)
            np.minimum.at(then, root[b], low)
            then = then[then]
            if (then == root).all():
                break
            root = then
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= most:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (u, v long); root: smallest node reachable.

    Edges are first made stars within each task (a bounded number at a time); then large-star and small-star
    rounds alternate.  Each is one aggregation with map-side combine and one join on the node, whose hot keys Spark may
    split.  Each round is written to the shared folder and the one before it deleted; all is done when each node
    hangs on one node that hangs on none.  Rounds grow with the logarithm of the longest path.
    """
    star = "u long, v long"
    now = materialise(edges.select("u", "v").where("u <> v").mapInArrow(_contract, star).distinct(), "edges")
    for _ in range(max_rounds):
        ends = now.select("u", F.lit(1).alias("child"), F.lit(0).alias("parent"), "v").unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("parent"), F.lit(None).cast("long").alias("v")))
        each = ends.groupBy("u").agg(F.max("child").alias("c"), F.max("parent").alias("p"), F.min("v").alias("low"), F.max("v").alias("high"))
        if each.where("(c = 1 and p = 1) or low <> high").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = materialise(large.mapInArrow(_contract, star).distinct(), "large")
        low = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        then = materialise(small.select("e.u", "e.v").where("u <> v").mapInArrow(_contract, star).distinct(), "small")
        forget(step)
        forget(now)
        now = then
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
