"""Session and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "docloom", **conf: str) -> SparkSession:
    """A session as the engine wants it: UTC, adaptive execution, right-wins map merges. Cluster settings are left alone."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder;
    a session in one process without either gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = have.get()
    return f"{root.rstrip('/')}/docloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
