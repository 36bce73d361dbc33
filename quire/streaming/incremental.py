"""Incremental outline refresh: new or changed files arriving in a folder are
outlined once per (path, content, options) key.

A file-source stream (``binaryFile``) feeds ``foreachBatch``; each micro-batch
drops files whose key is already in the result table (``outline_incremental``,
a left-anti join) and appends the outlines of the rest.  The stream checkpoint
and the result table live in shared storage, so a restarted job resumes where it
stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.functions.text import explode_lines
from quire.operators import code as C
from quire.operators.corpus import language_of

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _outline_batch(spark: SparkSession, batch: DataFrame, store: str, options: str) -> None:
    files = batch.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    try:
        done = spark.read.parquet(store).select("key")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # the first batch: no store yet
        done = spark.createDataFrame([], "key string")
    todo = C.outline_incremental(files, done, options)
    lines = explode_lines(todo.select("path", "key", "content"), "content") \
        .withColumn("language", language_of(F.col("path")))
    syms = C.outline_symbols(lines)
    out = syms.join(todo.select("path", "key"), "path")
    keys = todo.select("key", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("kind"),
                       F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("text"))
    out.select("key", "path", "kind", "line_no", "text").unionByName(keys) \
        .write.mode("append").parquet(store)


def start(spark: SparkSession, source_dir: str, store: str, checkpoint: str, options: str = "standard",
          once: bool = False):
    """Starts the stream; ``once`` processes what is there and stops (availableNow)."""
    stream = (spark.readStream.format("binaryFile").schema(SCHEMA)
              .option("recursiveFileLookup", "true").load(source_dir))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, _epoch: _outline_batch(spark, df, store, options)))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
