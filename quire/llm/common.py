"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

MASK64 = (1 << 64) - 1


#: Rows of an Arrow batch: whole texts are long, and Spark's 10,000 of them fill a worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by whatever file system its path names."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: cuts the
    lineage, keeps few columns cheap to read and survives the loss of executors."""
    small_batches(df.sparkSession)
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


class Memo(dict):
    """A bounded dictionary that computes missing values; it is emptied when full, so a
    stream of new keys cannot fill a worker."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
