"""Written tables in the folder that the cluster shares, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, one is made for local mode alone; on a cluster that is an error, since a machine's own folder is not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned. All that was derived from them must have been materialized too."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._webloom_path)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, or the sum of weight (for rows of no fixed size) is at most that; else as it is, for a shuffled join.

    df must be cheap to count: a materialized table or an aggregate of one.
    """
    size = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= most else df
