"""Session helpers. The library never builds a session for the caller."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used. Only where
    neither the setting nor a programmatic folder exists (local tests) is a temporary folder
    made, and only with a local master, since a machine-local folder does not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.getCheckpointDir():
        shared = sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="protoscan-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder as a table and go on from what was written.

    Cuts the lineage like a checkpoint, and later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/protoscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need it for the Arrow functions.

    Once per application; with ``spark-submit --py-files`` it is not needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_protoscan_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="protoscan-package-")
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{folder}/protoscan", "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sc._protoscan_shipped = True
