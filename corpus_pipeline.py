"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``quire.llm``.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``:

1. ``toxicity``: documents that the factorization machine rejects go.
2. ``near_duplicates``: one document of each component of the five-word Jaccard join (0.8) stays.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``personal_data``: personal data in the texts is replaced by its kind; n_chars follows.
5. ``packing``: the texts are tokenized, cut and packed into sequences.

Null and empty texts pass all stages (as a piece of the end token alone); other columns are left
as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, ngramjoin, packing, pii, toxicity
from quire.llm.common import read_table, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = store(pii.candidates(docs, keep=()), "pii-candidates")
    clean = pii.redacted(docs, pii.learn(found))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages),
          ("personal_data", redact_personal_data), ("packing", pack)]

#: The stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each over the written result of the one before."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{name}")
    return docs
