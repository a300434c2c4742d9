"""What the operators of this subpackage share: the shared folder, cutting lineage, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
#: Characters between words, as ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="claimgrid-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage; lost executors cost only what was not yet written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so what follows can prune columns and reuse it."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release_memory() -> None:
    """Gives memory that this process no longer uses back to the system, so that idle Python workers do not hold it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc only
        _LIBC.malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """The batches of a task; afterwards the worker's unused memory goes back."""
    try:
        yield from batches
    finally:
        release_memory()


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges(u, v)``, as ``(node, component)``.

    Alternating large-star and small-star rounds: each is two aggregations by key, no round holds a
    neighbourhood in one row, and the number of rounds, which end at the fixed point, grows with the logarithm of the longest chain.
    Every round is checkpointed. Empty edges give an empty result; nulls in u or v are left out.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    before = None
    while True:
        # large star: every neighbour above a node is tied to the least node around it
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's lower neighbours and the node itself are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
