"""Prepared corpora as Parquet tables, and keeping one open."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def write_dataset(corpus: DataFrame, path: str, by_directory: bool = False) -> None:
    """Write a corpus; ``by_directory`` makes one directory per chunk, which
    suits a moderate number of chunks."""
    writer = corpus.write.mode("errorifexists")
    if by_directory:
        writer = writer.partitionBy("chunk_id")
    writer.parquet(path)


def dataset_head(corpus: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in scan order.

    The cut is found on the keys alone; the text of other rows is never sorted
    or shuffled.
    """
    keys = corpus.select("seq").orderBy("seq").limit(n)
    last = keys.agg(F.max("seq").alias("last"))
    return corpus.filter(F.col("seq") <= last.scalar())


class OpenDataset:
    """The dataset a session currently searches.

    Opening the same path again returns the same DataFrame; another path, or
    ``force_reload``, releases the old one and reads anew.  ``keep_loaded``
    holds the rows on the executors, spilling to their disks: right for a
    corpus the cluster can hold, wrong for one it cannot.
    """

    VIEW = "dataset"

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._path = None
        self._corpus = None
        self._kept = False

    def open(self, path: str, force_reload: bool = False, keep_loaded: bool = False) -> DataFrame:
        if path != self._path or force_reload:
            self.close()
            self._spark.catalog.refreshByPath(path)
            self._path, self._corpus = path, self._spark.read.parquet(path)
        if keep_loaded != self._kept:
            self._kept = keep_loaded
            if keep_loaded:
                self._corpus.persist(StorageLevel.MEMORY_AND_DISK)
            else:
                self._corpus.unpersist()
        self._corpus.createOrReplaceTempView(self.VIEW)
        return self._corpus

    def close(self) -> None:
        if self._corpus is not None:
            self._corpus.unpersist()
            self._spark.catalog.dropTempView(self.VIEW)
        self._path = self._corpus = None
        self._kept = False


_open = {}


def open_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """:meth:`OpenDataset.open` on the one dataset of the application."""
    key = spark.sparkContext.applicationId
    if key not in _open:
        _open[key] = OpenDataset(spark)
    return _open[key].open(path, **options)
