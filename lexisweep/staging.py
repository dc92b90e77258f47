"""Intermediate tables in the folder all executors share."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_folders = {}
_staged = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's own process (tests) may leave
    it unset; it then gets a temporary folder of its own.  Whether a ``file:``
    folder is a mount that all machines share cannot be told from its name: that
    is for whoever sets it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lexisweep-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own, which ``drop_staged`` deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of the written table.

    Cuts lineage, survives the loss of executors, and lets several consumers
    share one scan of the text.  Runs a job.
    """
    return written(df, new_path(df.sparkSession, label))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class InnerTables:
    """The tables staged while a ``inner_tables`` block ran."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths = []

    def drop(self) -> None:
        """Delete them, once nothing reads them any more."""
        for path in self._paths:
            if path in _staged:
                release(self._spark, path)
        self._paths = []


@contextmanager
def inner_tables(spark: SparkSession):
    """Notes what is staged in the block, so that it can be dropped later."""
    inner, before = InnerTables(spark), len(_staged)
    yield inner
    inner._paths = _staged[before:]


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this application has staged; their readers are void."""
    for path in list(_staged):
        release(spark, path)


def release(spark: SparkSession, path: str) -> None:
    """Delete one path of ``new_path``; what reads it is void."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _staged:
        _staged.remove(path)
