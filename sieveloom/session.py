"""Session defaults; only those that are unset are chosen here, a cluster's own stay."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "sieveloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, shared by all executors: ``spark.checkpoint.dir``; a temporary one only where it is unset and the master local (tests)."""
    import os
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "sieveloom-checkpoints"))
    return found or spark.sparkContext.getCheckpointDir()


def cut(df):
    """The frame written to the shared folder and read back: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
