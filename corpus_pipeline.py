"""A corpus from raw documents to packed sequences, as stages over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsmetrics.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from opsmetrics.llm.queries import GOOD_FROM, TOKENIZER, id_bucket, read
from opsmetrics.session import configure, stage, work_path


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), may_learn=id_bucket("doc_id", 5) != 0)
    return quality.keep_good(docs, model, GOOD_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = exact_dedup.DigestIndex(spark, work_path(spark, "digest-index"), buckets).open()
    kept = exact_dedup.keep_first(docs, index, batches=2)
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, null ids last."""
    return simhash_dedup.keep_one(docs, radius=2, words=3, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs, weights=(5, 2, 1), total_ratio=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    return packing.pack_documents(docs, TOKENIZER, capacity=4096, end_id=1).withColumnRenamed("id", "doc_id")


STAGES = (
    ("quality classifier", drop_bad),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
)

# The classifier, the fingerprints, the fitted mix and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again by the next stage."""
    configure(spark)
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
