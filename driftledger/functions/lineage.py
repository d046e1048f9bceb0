"""Where plans are cut, so that what follows neither recomputes nor re-plans what came before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share.

    A local session without that setting gets /tmp/checkpoints; a cluster without it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed now, written to the shared folder and read back. The written rows go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftledger/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
