"""Hash chains, receipts, retention, redaction and keyed digests."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import folded


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, digits))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest (lower-case hex) of a string or binary column; two nested digests, no Python."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def chain_step(state, event):
    """One link.  State: (hash before, links so far); event: o and payload."""
    before, n = state
    now = hashlib.sha256(f"{before}|{event['payload']}".encode()).hexdigest()
    return (now, n + 1), (event["o"], n + 1, before, now)


def chained(events: DataFrame, stream: str, order: str, payload: str) -> DataFrame:
    """(stream, o, sequence, previous, hash): each hash covers the one before, so a stream is folded in its order.

    The order must be unique in a stream.
    """
    rows = events.select(stream, F.col(order).cast("long").alias("o"), F.col(payload).alias("payload"))
    return folded(rows, stream, ["o"], ("", 0), chain_step, "o long, sequence long, previous string, hash string")


def chain_faults(chain: DataFrame, stream: str, payload: str) -> DataFrame:
    """chain with `fault`: a gap in the sequence, a link that isn't the hash before, a hash that isn't the payload's; null if sound."""
    by = Window.partitionBy(stream).orderBy("sequence")
    place, before = F.row_number().over(by), F.coalesce(F.lag("hash").over(by), F.lit(""))
    fault = (
        F.when(F.col("sequence") != place, "sequence_gap")
        .when(F.col("previous") != before, "broken_link")
        .when(sha(F.col("previous"), F.col(payload)) != F.col("hash"), "hash_mismatch")
    )
    return chain.withColumn("fault", fault)


def receipts(events: DataFrame, scope: list[str], order: str, request: Column) -> DataFrame:
    """events with verdict: the first of its scope is new, later ones with the same request replay it, others conflict."""
    by = Window.partitionBy(*scope).orderBy(order)
    mark = F.sha2(request, 256)
    first = F.first(mark).over(by)
    return events.withColumn("verdict", F.when(F.row_number().over(by) == 1, "new").when(mark == first, "replay").otherwise("conflict"))


def purgeable(refs: DataFrame, holds: DataFrame, at: Column, strict: bool = True) -> DataFrame:
    """Snapshots of refs (snapshot, event, expires) that may go: all their events expired (any, if not strict), none held."""
    held = refs.join(holds.select("event").distinct().withColumn("held", F.lit(True)), "event", "left")
    past = F.col("expires") <= at
    gone = (F.bool_and if strict else F.bool_or)(past)
    return held.groupBy("snapshot").agg(gone.alias("gone"), F.bool_or(F.coalesce("held", F.lit(False))).alias("held")).where("gone and not held").select("snapshot")


def adjudicated(claims: DataFrame, audit: DataFrame, records: DataFrame, anchored: int) -> DataFrame:
    """claims (snapshot) with verdict: a purge must be in the audit up to the anchored sequence, and in the independent record."""
    a = audit.where(F.col("sequence") <= anchored).select("snapshot").distinct().withColumn("audited", F.lit(True))
    r = records.select("snapshot").distinct().withColumn("recorded", F.lit(True))
    both = claims.join(a, "snapshot", "left").join(r, "snapshot", "left")
    verdict = F.when(F.col("audited").isNull(), "not_anchored").when(F.col("recorded").isNull(), "not_recorded").otherwise("accepted")
    return both.select("snapshot", verdict.alias("verdict"))


def redacted(value: Column, drop: list[str], digest: list[str], key: bytes) -> Column:
    """JSON with values of `drop` keys replaced and of `digest` keys hashed, at any depth; what isn't JSON becomes null.

    The depth is unknown, so this is an Arrow-batched function.
    """
    def walk(v):
        if isinstance(v, dict):
            out = {}
            for k, x in v.items():
                if k in drop:
                    out[k] = "[REDACTED]"
                elif k in digest:
                    out[k] = "hmac-sha256:" + hmac.new(key, json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()
                else:
                    out[k] = walk(x)
            return out
        return [walk(x) for x in v] if isinstance(v, list) else v

    def run(col):
        def one(t):
            try:
                return json.dumps(walk(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return col.map(one)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(value)
