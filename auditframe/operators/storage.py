"""Tables that cut a lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """``df``, computed once by a reliable checkpoint; without ``spark.checkpoint.dir`` this is an error on a cluster, a temporary folder on one machine."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="auditframe-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once as compressed columns in the checkpoint folder: for tables that several checks and joins read."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (folder.get() if folder.isDefined() else None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="auditframe-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/auditframe-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
