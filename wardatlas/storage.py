"""Shared-folder helpers: checkpoints, scratch tables, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode one of the session's own where that is unset.

    On a cluster a folder of one machine would split the data, so an unset name is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return in_use.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_wardatlas_folder", None)
    if own is None:
        own = spark.sparkContext._wardatlas_folder = tempfile.mkdtemp(prefix="wardatlas-")
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the shared checkpoint folder."""
    _name_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_rdd(spark: SparkSession, rdd: RDD) -> RDD:
    """The same for an RDD."""
    _name_checkpoints(spark)
    rdd.persist(StorageLevel.MEMORY_AND_DISK)              # else its files are written by a second computation
    rdd.checkpoint()
    rdd.count()
    return rdd.unpersist()


def _name_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table that is written and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    root = os.path.dirname(os.path.abspath(__file__))
    sc = spark.sparkContext
    if getattr(sc, "_wardatlas_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="wardatlas-pkg-"), "wardatlas_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._wardatlas_shipped = True
