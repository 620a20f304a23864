"""Benchmark decontamination by a prefix-filtered join and exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, ascii_lower, restrict, settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; windows of fewer words are one shingle each.
SHINGLE = 3
#: Words of a piece of a document that a candidate is verified in (and what a window needs beyond).
PIECE = 256


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(w: Column, size: int) -> Column:
    """Hashes of the `size` words from each place on, as (hash, place)."""
    at = F.sequence(F.lit(0), F.size(w) - size)
    made = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("at")))
    return F.when(F.size(w) >= size, made).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """Where item windows occur in documents.

    A window needs all its shingles, so its necessary prefix is one of them:
    the rarest in the corpus (ties by the place).  The places of documents'
    shingles are joined with those prefixes, the position bounds drop windows
    that would stand over an end, and what is left is compared word by word, a
    row for each candidate, inside pieces of documents.  So a row never holds
    more than PIECE + window words, however long a document is.

    Returns id, n_words, n_hit, items (sorted strings of item ids).

    Defined results: null or wordless texts have no words and no hits; items
    without words have no windows; what is found depends on the text alone, so
    rows with null ids are judged like others and rows that repeat an id come
    out again, each with its own text's result; empty tables give no hits;
    other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.withColumn("__key", F.md5("__text"))
    item = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s")
    of_item = settle(item.select("item", "w", starts).select("item", F.expr(f"slice(w, s + 1, {window})").alias("win")).distinct(), "decontam-windows")
    wins = of_item.select("win").distinct().withColumn("wid", F.monotonically_increasing_id())
    wins = settle(wins, "decontam-ids").withColumn("len", F.size("win"))
    sizes = sorted({min(SHINGLE, r["len"]) for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("len")).distinct().collect()})

    def exploded(rows: DataFrame, w: str, of_len: str | None = None) -> DataFrame:
        """rows with h, size and place of their shingles; windows have those of one size, documents of all that occur."""
        out = None
        for k in sizes or [SHINGLE]:
            some = rows if of_len is None else rows.where(F.least(of_len, F.lit(SHINGLE)) == k)
            some = some.withColumn("g", F.explode(shingles(F.col(w), k))).drop(w).withColumns({"h": F.col("g.h"), "at": F.col("g.at"), "k": F.lit(k)})
            out = some.drop("g") if out is None else out.unionByName(some.drop("g"))
        return out

    mine = settle(exploded(wins, "win", "len"), "decontam-shingles")
    vocab = mine.select("h", "k").distinct()
    n = vocab.count()
    spots = exploded(base.select("__key", words(F.col("__text")).alias("w")).withColumn("n", F.size("w")), "w")
    spots = settle(spots.join(F.broadcast(vocab) if n <= BROADCAST_KEYS else vocab, ["h", "k"], "left_semi"), "decontam-spots")
    rarity = spots.groupBy("h", "k").agg(F.count(F.lit(1)).alias("df"))
    # a window with a shingle that the corpus lacks can't occur
    ranked = mine.join(rarity, ["h", "k"])
    anchors = ranked.groupBy("wid", "len", "k").agg(F.min(F.struct("df", "at", "h")).alias("m"), F.count(F.lit(1)).alias("have"))
    anchors = anchors.where(F.col("have") == F.col("len") - F.col("k") + 1)
    anchors = settle(anchors.select("wid", "len", "k", F.col("m.h").alias("h"), F.col("m.at").alias("off")), "decontam-anchors")
    small = F.broadcast if anchors.count() <= BROADCAST_KEYS else (lambda df: df)
    cands = spots.join(small(anchors), ["h", "k"]).withColumn("start", F.col("at") - F.col("off"))
    cands = cands.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    cands = settle(cands.select("__key", F.expr(f"start div {PIECE}").cast("int").alias("piece"), "start", "wid", "len").distinct(), "decontam-candidates")
    wanted = settle(cands.select("__key").distinct(), "decontam-wanted")
    near = restrict(base, wanted, "__key", wanted.count()).dropDuplicates(["__key"]).select("__key", words(F.col("__text")).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE)), lambda i: F.slice(F.col("w"), i + 1, PIECE + window - 1))
    pieces = near.where(F.size("w") > 0).select("__key", F.posexplode(cut).alias("piece", "part"))
    both = cands.join(wins.select("wid", "win"), "wid").join(pieces, ["__key", "piece"])
    same = F.slice("part", F.col("start") - F.col("piece") * PIECE + 1, F.col("len")) == F.col("win")
    hits = settle(both.where(same).select("__key", "start", "wid", "len"), "decontam-hits")
    covered = hits.select("__key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at")).distinct()
    covered = covered.groupBy("__key").agg(F.count(F.lit(1)).alias("n_hit"))
    found = hits.select("__key", "wid").distinct().join(wins.select("wid", "win"), "wid").join(of_item, "win")
    found = found.select("__key", "item").distinct().groupBy("__key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = settle(covered.join(found, "__key").withColumnRenamed("__key", "__r"), "decontam-result")
    side = F.broadcast(result) if result.count() <= BROADCAST_KEYS // 8 else result
    return base.join(side, F.col("__key") == F.col("__r"), "left").select(
        F.col("__id").alias(id_col),
        F.size(words(F.col("__text"))).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
