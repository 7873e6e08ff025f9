"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, also set as its checkpoint folder.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that folder would be seen by the
    driver alone, so a missing setting raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="krylark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base
