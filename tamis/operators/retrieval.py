"""Retrieval of passages: who may see them, how they score, the best of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import key_terms, passage_key, search_tokens, text_key

BUCKETS = 64
#: Queries that are compared at once.
QUERY_BLOCK = 1000
# fixed values: shares of the three scores, least total, phrases that look like instructions
WEIGHTS = {"metadata": 3000, "lexical": 5000, "vector": 2000}
LEAST = 800
INSTRUCTIONS = ["IGNORE PREVIOUS INSTRUCTIONS", "REVEAL SYSTEM PROMPT", "SYSTEM MESSAGE", "CALL A TOOL", "EXFILTRATE", "DISREGARD POLICY"]


def instructions(value: Column) -> Column:
    """Names of the instruction phrases in a text."""
    found = F.filter(F.array(*map(F.lit, INSTRUCTIONS)), lambda p: F.contains(text_key(value), p))
    return F.transform(found, lambda p: F.lower(F.replace(p, F.lit(" "), F.lit("_"))))


def bucket(token: str) -> int:
    """FNV-1a of a token's bytes, 32 bits, modulo BUCKETS."""
    h = 2166136261
    for c in token.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


class Vectors(dict):
    """token -> its bucket; tokens come again and again, so each is hashed once."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[token] = bucket(token)
        return k

    def matrix(self, lists) -> np.ndarray:
        """How many of each list's tokens fall into each bucket."""
        return np.array([np.bincount([self[t] for t in ts], minlength=BUCKETS) for ts in lists], np.int64).reshape(-1, BUCKETS)


class Queries:
    """A block of queries as matrices, to be compared with blocks of chunks."""

    def __init__(self, rows) -> None:
        self.ids = [r["query_id"] for r in rows]
        self.tokens = [list(r["qt"]) for r in rows]
        self.codes = sorted({c for r in rows for c in r["codes"]})
        self.words = {t: k for k, t in enumerate(sorted({t for ts in self.tokens for t in ts}))}
        self.sizes = np.array([max(1, len(ts)) for ts in self.tokens])
        self.has_word = self.incidence(self.tokens)
        self.has_code = np.array([[r["codes"].count(c) for c in self.codes] for r in rows], np.int64).reshape(len(rows), len(self.codes))
        self.vectors = Vectors().matrix(self.tokens)

    def incidence(self, lists) -> np.ndarray:
        out = np.zeros((len(lists), max(1, len(self.words))), np.float32)  # counts below 2^24: exact
        for k, ts in enumerate(lists):
            out[k, [self.words[t] for t in ts if t in self.words]] = 1
        return out

    def scores(self, lists, said, vectors: Vectors) -> dict[str, np.ndarray]:
        """Chunks by queries: metadata, lexical and vector scores and their points, all whole numbers that cut off."""
        inside = np.array([[c in s for c in self.codes] for s in said], np.int64).reshape(len(said), len(self.codes))
        meta = np.minimum(10000, inside @ self.has_code.T * 1500)
        lexical = (self.incidence(lists) @ self.has_word.T).astype(np.int64) * 10000 // self.sizes
        v = vectors.matrix(lists)
        norm = (v**2).sum(1)[:, None] + (self.vectors**2).sum(1)[None, :]
        some = (v.sum(1) > 0)[:, None] & (self.vectors.sum(1) > 0)[None, :]
        near = np.where(some, 2 * (v @ self.vectors.T) * 10000 // np.maximum(norm, 1), 0)
        out = {"metadata": meta, "lexical": lexical, "vector": near}
        return out | {"points": sum(out[k] * w // 10000 for k, w in WEIGHTS.items())}


def exclusion(spec: dict[str, Column], tenant: Column, scope: Column, at: Column) -> Column:
    """Why a document may not be used, or null: its tier or approval, its tenant or scope, its dates (the last day included)."""
    unfit = ~spec["tier"].isin("A", "B", "C") | ~spec["approval"].isin("approved", "published", "validated")
    foreign = ((F.coalesce(spec["tenant"], F.lit("")) != "") & ~spec["tenant"].eqNullSafe(tenant)) | ~F.array_contains(spec["scopes"], scope)
    late = (spec["valid_from"].isNotNull() & (at < spec["valid_from"])) | (spec["valid_to"].isNotNull() & (at >= F.date_add(spec["valid_to"], 1)))
    return F.when(unfit, "unapproved_or_ineffective").when(foreign, "tenant_or_scope").when(late, "unapproved_or_ineffective")


def retrieved(queries: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """The `top` chunks (chunk_id, text, meta) of each query (query_id, text, codes) with LEAST points or more.

    A stated set of queries is compared with all chunks, in blocks of both, as
    matrix products; a block hands on no more than `top` chunks a query, so
    what moves doesn't grow with the pairs.  Ties go to the smaller chunk_id;
    null texts count as empty.
    """
    asked = queries.select("query_id", search_tokens(F.col("text")).alias("qt"), F.transform("codes", lambda c: text_key(c)).alias("codes"))
    rows = chunks.select("chunk_id", search_tokens(F.col("text")).alias("ct"), text_key(F.concat_ws(" ", "meta", "text")).alias("said"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"))]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, metadata long, lexical long, vector long, points long"

    def compare(block):
        def run(frames):
            vectors = Vectors()
            for pdf in frames:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256].sort_values("chunk_id", ignore_index=True)
                    found = block.scores(part["ct"], part["said"], vectors)
                    order = np.argsort(-found["points"], axis=0, kind="stable")[:top]  # equal points stay in the order of ids
                    at_query = np.broadcast_to(np.arange(len(block.ids)), order.shape).ravel()
                    at_chunk = order.ravel()
                    good = found["points"][at_chunk, at_query] >= LEAST
                    i, j = at_chunk[good], at_query[good]
                    yield pd.DataFrame({"query_id": [block.ids[k] for k in j], "chunk_id": part["chunk_id"].to_numpy()[i], **{k: v[i, j] for k, v in found.items()}})

        return run

    out = None
    stated = asked.collect()  # the stated queries, not the corpus
    for lo in range(0, max(1, len(stated)), QUERY_BLOCK):
        some = rows.mapInPandas(compare(Queries(stated[lo : lo + QUERY_BLOCK])), schema)
        out = some if out is None else out.unionByName(some)
    best = Window.partitionBy("query_id").orderBy(F.desc("points"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


def passages_for(queries: DataFrame, passages: DataFrame, top: int = 6) -> DataFrame:
    """The `top` passages (passage_id, tenant, title, text) for the terms of each query (query_id, tenant, text): 4 points a term in the title, 2 in the text.

    Terms meet passages by equality, so a passage without any costs nothing.
    """
    q = queries.select("query_id", F.col("tenant").alias("asked"), F.explode(key_terms(passage_key(F.col("text")))).alias("term"))
    held = [("title", 4), ("text", 2)]
    p = None
    for c, points in held:
        one = passages.select("passage_id", "tenant", F.explode(F.array_distinct(F.filter(F.split(passage_key(F.col(c)), " "), lambda t: F.length(t) >= 2))).alias("term"), F.lit(points).alias("points"))
        p = one if p is None else p.unionByName(one)
    hits = p.join(q, "term").where("tenant = '*' or tenant = asked")
    scored = hits.groupBy("query_id", "passage_id").agg(F.sum("points").alias("score"), F.array_sort(F.collect_set("term")).alias("terms"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
