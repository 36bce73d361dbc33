"""The given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPREAD_MIN_BYTES = 4 << 20


def spread(df: DataFrame, min_bytes: int = SPREAD_MIN_BYTES) -> DataFrame:
    """Round-robin a scan across the cluster when it yields fewer partitions than
    there are cores (a single large row group).  Text work per row is CPU heavy,
    so the shuffle pays for itself; a scan over many files (the large-scale case)
    already has enough splits and is left untouched."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return df
    if size < min_bytes:
        return df
    if df.rdd.getNumPartitions() >= par:
        return df
    return df.repartition(par)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
