"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: on a local master a folder of this process, removed at its
    end; on a cluster an error, since no machine's own folder is seen by all executors."""
    sc = spark.sparkContext
    said = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="wordloom-")
        atexit.register(shutil.rmtree, path, True)
        _own[sc.applicationId] = f"file://{path}"
    return _own[sc.applicationId]
