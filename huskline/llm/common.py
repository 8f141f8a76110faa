"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: with the longest documents (100 kB) a batch stays near 50 MB.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where none is set."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Delete what `stash` wrote, once nothing will be read from it any more."""
    for df in stashes:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(df: DataFrame, name: str, kind: str):
    """Column `name` cast to `kind`, or null where the table has no such column."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
