"""From raw documents to packed sequences: toxicity, exact and near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm import toxicity as tox
from tamis.llm.common import settle, without
from tamis.llm.decontam import contamination
from tamis.llm.exact_dedup import drop_duplicates_exact
from tamis.llm.ngram_join import drop_near_duplicates
from tamis.llm.packing import pack_documents
from tamis.llm.queries import TOXIC_FROM, toxic_model


def by_text(docs):
    """docs with a key of the text: what a stage finds out depends on the text alone, and ids may be null or repeat."""
    return docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def toxicity(spark, docs, sf_dir):
    """Documents that score below the threshold stay; the model learns from the labels of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    keyed = by_text(docs)
    scores = tox.toxicity(keyed, toxic_model(docs, labels), "key").where(F.col("score") >= TOXIC_FROM)
    return without(keyed, scores.select("key").distinct(), "key").drop("key")


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts one row with the largest doc_id stays."""
    return drop_duplicates_exact(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each component of linked documents (five words, 0.8) the least doc_id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents in which a window of a benchmark item occurs go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keyed = by_text(docs)
    hit = contamination(keyed, items, "key").where("n_hit > 0").select("key")
    return without(keyed, hit.distinct(), "key").drop("key")


def packing(spark, docs, sf_dir):
    """Pieces of the documents with their place in sequences of at most 2,048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Model scores, components and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
