"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder named by ``spark.checkpoint.dir``.

    Only where a local session (as in tests) names none, a temporary folder is made
    and set, so that every later call gets the same one. A cluster must name one.
    """
    path = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(_SETTING, path)
    if "://" not in path:
        path = "file://" + path if path.startswith("/") else path
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a URI, as the JVM's."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder not used before, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, folder = hadoop(spark, path)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(f"{path}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, as a table in the shared folder.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and
    a join of two such tables starts from two plain exchanges, which adaptive
    execution can split where a key is hot.
    """
    return _written(df, new_folder(df.sparkSession, name))


class Scratch:
    """Written tables that are freed together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.folders.append(new_folder(self.spark, name))
        return _written(df, self.folders[-1])

    def free(self) -> None:
        for path in self.folders:
            fs, folder = hadoop(self.spark, path)
            fs.delete(folder, True)
        self.folders.clear()
