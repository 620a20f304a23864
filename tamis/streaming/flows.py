"""Streams: windowed counts, first requests, rate limits and leases with state, appends that may run twice.

Each takes and returns a streaming DataFrame; `drained` runs one over what is
there now and reads back what it wrote.  The rules of stateful flows are the
step functions of `tamis.operators.state`, so a stream and a batch agree.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tamis.operators.state import bucket_step, lease_step, micros


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; without the setting a local one, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tamis-checkpoints")
    return f"{base.rstrip('/')}/tamis-streams/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parquet*")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream makes of all that is there now, written in append mode, read back."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    flow = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    flow.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def counted(stream: DataFrame, at: Column, by: list[str], window: str, delay: str) -> DataFrame:
    """Events and different users by window, once the watermark has passed its end; later events are dropped from it."""
    timed = stream.withColumn("at", at.cast("timestamp")).withWatermark("at", delay)
    out = timed.groupBy(F.window("at", window), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n")


def first_requests(stream: DataFrame, at: Column, scope: list[str], delay: str) -> DataFrame:
    """Requests whose scope hasn't been seen within the delay: repeats are dropped, and state is freed as time goes on."""
    return stream.withColumn("at", at.cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(scope)


def stateful(stream: DataFrame, key: str, order: list[str], start, step, state: str, out: str) -> DataFrame:
    """Events of each key folded by step, in order inside a micro-batch; the state, a tuple, is kept between batches."""
    kind = stream.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in out.split(", "))]

    def run(ident, frames, held):
        now = held.get if held.exists else start
        now = tuple(now) if now is not None else None
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = []
        for event in pdf.to_dict("records"):
            now, made = step(now, event)
            rows.append((ident[0], *made))
        held.update(now)
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def admitted(stream: DataFrame, key: str, order: str, at: str, per_minute: int, burst: int) -> DataFrame:
    """(key, o, allowed) by a token bucket per key."""
    rows = stream.select(key, F.col(order).cast("long").alias("o"), micros(F.col(at)).alias("at"))
    return stateful(rows, key, ["at", "o"], None, bucket_step(per_minute, burst), "tokens double, last long", "o long, allowed boolean")


def leased(stream: DataFrame, key: str, order: str, at: str, lease_s: int, max_attempts: int) -> DataFrame:
    """(key, o, outcome) of claims and completions of queued messages."""
    rows = stream.select(key, F.col(order).cast("long").alias("o"), micros(F.col(at)).alias("at"), "action")
    return stateful(rows, key, ["o"], ("pending", 0, 0), lease_step(lease_s * 1_000_000, max_attempts), "state string, until long, attempts long", "o long, outcome string")


def appended(batch: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table at path lacks are added: for foreachBatch, where a batch may come twice."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    try:
        there = spark.read.schema(batch.schema).parquet(path).select(key)
    except Exception as missing:  # noqa: BLE001  the first batch finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        rows = rows.join(there, key, "left_anti")
    rows.write.mode("append").parquet(path)
