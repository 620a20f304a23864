"""Exact deduplication by progressive refinement (length, prefix hash, full hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, ascii_lower, one_of_each, restrict, settle

#: Code points of the prefix that the second step hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text that is compared: null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, text_col: str, prefix: int, every: bool = False) -> DataFrame:
    """docs with __sha, the digest of the normalised text, and __twin, whether its length and prefix hash repeat.

    Rows are told by their texts alone, never by an id.  Without `every`, rows
    that are no twins have a value of their text's 64-bit hash for __sha.
    """
    text = normalised(F.col(text_col))
    narrow = docs.select(text.alias("__text"), F.octet_length(text).alias("__len"))
    by_len = narrow.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__len")
    by_len = settle(by_len, "dedup-lengths")
    key = F.xxhash64("__len", F.substring("__text", 1, prefix))
    same_len = restrict(narrow, by_len, "__len", by_len.count()).select(key.alias("__key"))
    by_key = same_len.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key")
    by_key = settle(by_key, "dedup-survivors")
    keyed = docs.withColumn("__text", text).withColumn("__len", F.octet_length("__text")).withColumn("__key", key)
    side = by_key.withColumnRenamed("__key", "__found")
    side = F.broadcast(side) if by_key.count() <= BROADCAST_KEYS else side
    both = keyed.join(side, F.col("__key") == F.col("__found"), "left").withColumn("__twin", F.col("__found").isNotNull())
    sha = F.sha2(F.col("__text"), 256)
    if not every:
        sha = F.when(F.col("__twin"), sha).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("__text"))))
    return both.withColumn("__sha", sha).drop("__text", "__len", "__key", "__found")


def groups_of(rows: DataFrame) -> DataFrame:
    """(__sha, keep_id, copies, __first, group_size) of the texts that several rows (__id, __row, __sha, __twin) have.

    copies: rows with that text and id; __first: the __row of one of them.
    """
    same = rows.where("__twin").groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("row"))
    top = F.max(F.struct("__id", "n", "row")).alias("top")
    groups = same.groupBy("__sha").agg(top, F.sum("n").alias("group_size")).where("group_size > 1")
    return groups.select(
        "__sha", F.col("top.__id").alias("keep_id"), F.col("top.n").alias("copies"), F.col("top.row").alias("__first"), "group_size"
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False
) -> DataFrame:
    """Groups of equal texts; one row with the largest id of each stays.

    Three steps, each over the rows that the one before left:

    1. byte length: a length that one row alone has ends there;
    2. length and hash of the first ``prefix`` characters;
    3. SHA-256 of the whole text (with ``digest``, of every text).

    Only lengths, 64-bit hashes, ids and digests move; texts never leave the
    task that scans them while the survivors' hashes fit a broadcast.  Groups
    are formed by aggregation with a partial step, so a group with a third of
    all rows is a handful of partial rows per task.

    Returns one row per input row: id, keep_id, group_size (long), kept; with
    ``digest`` also text_sha256, in lower-case hex.

    Defined results: null text counts as empty and groups with empty texts; a
    null id is an id smaller than any other; rows are counted, not ids, so
    rows which repeat an id and a text are copies of each other, and exactly
    one row of a group is kept; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    base = digests(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", prefix, digest).drop("__t")
    rows = settle(base.withColumn("__row", F.monotonically_increasing_id()), "dedup-full")
    groups = settle(groups_of(rows), "dedup-groups")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_KEYS // 4 else groups
    out = rows.join(side, "__sha", "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__row") == F.col("__first"), F.lit(True)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    return out if digest else out.drop("text_sha256")


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row of every group of equal texts, that with the largest id, and all other rows; all their columns kept."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__all"), docs[id_col].alias("__id"), docs[text_col].alias("__t"))
    marked = digests(packed, "__t", prefix)
    rows = settle(marked.where("__twin").select("__id", F.lit(0).alias("__row"), "__sha", "__twin"), "dedup-full")
    groups = groups_of(rows).select("__sha", F.col("__sha").alias("win"), F.col("keep_id").alias("id"), "copies")
    return one_of_each(marked, settle(groups, "dedup-groups"), "__sha", "__id").select("__all.*")
