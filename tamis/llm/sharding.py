"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined

#: The ring has this many cells; virtual nodes stand on cell borders.  Their
#: counts are what the driver gathers: 65,536 longs at most, at any input size.
CELLS = 1 << 16
#: Virtual nodes of each shard.
VNODES = 64


@dataclass(frozen=True)
class Run:
    """Ranks lo..hi-1 of a cell go to shard, from slot on."""

    cell: int
    lo: int
    hi: int
    shard: int
    slot: int


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise; a taken cell moves the later node on."""
    if not 0 < shards * vnodes <= cells:
        raise ValueError("the ring needs a cell for each virtual node")
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % cells
            while cell in at:
                cell = (cell + 1) % cells
            at[cell] = shard
    return sorted(at.items())


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[Run]:
    """Where the rows of each cell go.

    A cell belongs to the first virtual node at or after it.  Capacities are
    the even split of the rows (one more for the first few shards).  Every
    node first takes the rows of its own cells, in clockwise order, until its
    shard is full; rows left over then continue clockwise to the next nodes
    whose shards still have room.
    """
    nodes = ring(shards, vnodes, cells)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs: list[Run] = []
    left: list[list[tuple[int, int, int]]] = [[] for _ in nodes]  # (cell, lo, hi) that a node couldn't take

    def put(cell: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n:
            runs.append(Run(cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return lo + n

    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        node = at % len(nodes)
        lo = put(cell, 0, counts[cell], nodes[node][1])
        if lo < counts[cell]:
            left[node].append((cell, lo, counts[cell]))
    for node, spilt in enumerate(left):
        step = node
        for cell, lo, hi in spilt:
            while lo < hi:  # ends: the rooms add up to the rows
                lo = put(cell, lo, hi, nodes[step % len(nodes)][1])
                step += lo < hi
    return runs


def shard_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    vnodes: int = VNODES,
    cells: int = CELLS,
) -> DataFrame:
    """Rows of docs with shard and slot, shard counts at most one apart.

    A row's place on the ring is a hash of its id (of its text without one), so it moves only when its
    arc changes hands or its shard overflows.  The driver sees one count per
    cell; ranks are taken inside a cell, which holds 1/65,536 of the rows.

    Returns id, size (UTF-8 bytes + 1), text_crc32, shard, slot.

    Defined results: null text has size 1 and the CRC of no bytes; null and
    repeated ids are placed like others (rows of one id share a cell and are
    ranked by CRC and size, so equal rows are interchangeable); an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    place = F.xxhash64(F.when(F.col("__id").isNull(), F.struct("text_crc32", "size")), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    rows = rows.withColumn("__pos", place)
    rows = rows.withColumn("__cell", F.pmod("__pos", F.lit(cells)).cast("int"))
    counted = rows.groupBy(F.col("__cell").alias("cell")).count()
    runs = fill({r["cell"]: r["count"] for r in counted.collect()}, shards, vnodes, cells)  # at most `cells` rows
    # at most cells + shards * vnodes rows of five integers: some 3 MB
    plan = docs.sparkSession.createDataFrame(
        [(r.cell, r.lo, r.hi, r.shard, r.slot) for r in runs] or [(-1, 0, 0, 0, 0)],
        "__cell int, __lo long, __hi long, shard int, __from long",
    )
    by_cell = plan.groupBy("__cell").agg(F.collect_list(F.struct("__lo", "__hi", "shard", "__from")).alias("__runs"))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__pos", "__id", "text_crc32", "size")) - 1
    placed = joined(rows.withColumn("__rank", rank.cast("long")), F.broadcast(by_cell), ["__cell"], "inner")
    run = F.filter("__runs", lambda r: (r["__lo"] <= F.col("__rank")) & (F.col("__rank") < r["__hi"]))[0]
    return placed.withColumn("__run", run).select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.col("__run.shard").alias("shard"),
        (F.col("__run.__from") + F.col("__rank") - F.col("__run.__lo")).alias("slot"),
    )
