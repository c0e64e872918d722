"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch, where a session has Spark's default of 10,000: whole texts travel, and a batch of them is held several times over.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine for tests and trials."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application; the driver serves a small archive of its sources."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="fathomline-src-"), "fathomline_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.join("fathomline", os.path.relpath(file, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both reach files: below spark.checkpoint.dir; where that isn't set and all runs in one local process, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fathomline.work.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("fathomline.work.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/fathomline/{spark.sparkContext.applicationId}"
