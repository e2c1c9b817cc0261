"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local session gets a folder of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.skygrid.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.skygrid.scratch", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later jobs start there, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
