"""The folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a session whose tasks all run in the driver's own process, as in tests, gets a temporary one;
    on a cluster that is an error, as each executor would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tarnquery-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
