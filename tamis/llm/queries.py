"""Contract queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language_id, quality
from .common import BROADCAST_KEYS
from .decontam import contamination
from .exact_dedup import exact_dedup
from .license_scan import licences
from .ngram_join import near_duplicates
from .packing import pack_documents
from .pii import KINDS, listed, sanitised_spans
from .sharding import shard_rows
from .toxicity import toxicity, train


def op5_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.col("doc_id") == F.col("keep_id")  # as in the SQL: every copy with the largest id, and null for a null id
    return exact_dedup(docs, digest=True).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op7_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op6_license_scan(spark, sf_dir):
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


#: Documents that score this or more are toxic.
TOXIC_FROM = 0.3


def toxic_model(docs, labels):
    """Learns from the labelled rows outside the held-out fold."""
    labels = labels.where("toxic is not null").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    side = F.broadcast(labels) if labels.count() <= BROADCAST_KEYS else labels
    return train(docs.select("doc_id", "text").join(side, "doc_id").select("text", "toxic"))


def op3_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxic_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op1_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return sanitised_spans(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_ngram_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=4, percent=85)


def op4_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.languages(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    model = quality.train(docs.join(labels.where(~held_out(F.col("doc_id"))), "doc_id"))
    return quality.quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_ngram_jaccard, op3_toxicity, op4_packing, op5_exact_dedup, op6_license_scan, op7_sharding, op8_language_id, op9_quality, op10_decontamination)
}

ORACLE = {
    "op5_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM iw
), dw AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens)
), hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (win)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
