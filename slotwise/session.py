"""Session defaults and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "slotwise", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the session comes from spark-submit; no operator relies on the
    values set here (time zone included).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder all executors share (``spark.checkpoint.dir``).

    A session on one machine that names none gets one folder of its own for all calls,
    since driver and tasks are the same process there; any other session must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"slotwise-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/slotwise/{purpose}-{uuid.uuid4().hex}"
