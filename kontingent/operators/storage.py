"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session names none, a temporary folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kontingent.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kontingent-")
        spark.conf.set("kontingent.shared.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, safe against lost executors.

    by: a column of few values, by which files are kept apart, so that a filter on it reads only its own.
    """
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote and nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            t._stored_at = None
