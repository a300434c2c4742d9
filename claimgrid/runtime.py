"""Sessions, the shared folder and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "claimgrid", **conf: str) -> SparkSession:
    """A session with the settings that the engine counts on; a cluster's own settings stand."""
    b = SparkSession.builder.appName(app)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not at:
        if not known.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = known.get() if known.isDefined() else tempfile.mkdtemp(prefix=f"claimgrid-{os.getpid()}-")
    if not known.isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder, compressed and by columns, and cuts its lineage; the shuffles that made it are given back.

    Frames that Parquet does not hold (equal column names, columns without a type) are checkpointed as rows.
    """
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if len({c.lower() for c in df.columns}) < len(df.columns) or re.search(r"\b(void|interval|variant)\b", df.schema.simpleString()):
        return df.checkpoint(eager=True)
    df.write.option("compression", "zstd").parquet(at)
    spark.sparkContext._jvm.System.gc()  # what nobody refers to now is taken off the executors' disks
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a frame that ``checkpoint`` wrote, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stored-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
