"""Where streams keep checkpoints and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder for one run, below the shared folder that the cluster names.

    Only a local session without that setting falls back to a folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="inferlytics-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
