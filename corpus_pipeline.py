"""From raw documents to packed sequences: each stage is written as Parquet and read again as the next one's documents.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of `documents`; n_chars follows the text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dups, packing, secret_scan, toxicity
from tidemark.llm.common import fresh, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least toxicity.CUT go. The model comes from the labels of the training part."""
    (score,) = fresh(docs, "score__")
    return toxicity.with_toxicity(docs, table(spark, sf_dir, "labels"), out=score).where(F.col(score) < toxicity.CUT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return near_dups.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go."""
    (found,) = fresh(docs, "found__")
    return decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), out=found).where(F.col(f"{found}.n_hit") == 0).drop(found)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    (spans,) = fresh(docs, "spans__")
    docs = secret_scan.with_secrets(docs, out=spans)
    docs = docs.withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans))).drop(spans)
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, ids, sequence and place there."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{root}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
