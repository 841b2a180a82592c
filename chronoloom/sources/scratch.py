"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster sets it; a temporary folder where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("chronoloom.local.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="chronoloom-scratch-")
        spark.conf.set("chronoloom.local.scratch", own)
    return own


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
