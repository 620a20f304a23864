"""Queries of streams and constraints, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import constraints as C
from tamis.streaming import flows

from .base import bound, table


def stream_counts(spark, sf_dir):
    """Events by day and type, of the days that the watermark has passed."""
    events = flows.source(spark, sf_dir, "events")
    return flows.drained(flows.counted(events, F.col("ts"), ["event_type"], "1 day", "2 hours"), "counts").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_first_requests(spark, sf_dir):
    """The first event of each user, type and key of the whole stream."""
    events = flows.source(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 50)
    out = flows.drained(flows.first_requests(events, F.col("ts"), ["user_id", "event_type", "k"], "60 days"), "first")
    return out.select("user_id", "event_type", "k")


def stream_rate_limit(spark, sf_dir):
    """Events that token buckets let pass, with state kept between batches."""
    events = flows.source(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 7)
    return flows.drained(flows.admitted(events, "bucket", "event_id", "ts", 1, 2), "limit")


def stream_leases(spark, sf_dir):
    events = flows.source(spark, sf_dir, "events").withColumn("action", F.when(F.col("event_type").isin("purchase", "signup") & (F.col("value") < 12), "complete").otherwise("claim"))
    return flows.drained(flows.leased(events, "user_id", "event_id", "ts", 6 * 3600, 12), "leases")


def line_constraints(spark, sf_dir):
    """Rules that lines break, counted."""
    rows = table(spark, sf_dir, "lineitem")
    tokens = F.array(F.col("l_returnflag"), F.col("l_linestatus"))
    checks = {
        "flag_known": F.col("l_returnflag").isin("A", "R"),
        "quantity_in_range": F.col("l_quantity").between(1, 49),
        "tokens_canonical": C.canonical(tokens),
        "price_filled": C.filled(F.col("l_extendedprice").cast("string")),
    }
    return C.violations(rows, "l_orderkey", checks).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def line_quarantine(spark, sf_dir):
    """Lines kept and put aside."""
    good, bad = C.parted(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") <= 45, "tax": F.col("l_tax") < 0.08})
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("broken"), "n").union(bad.groupBy(F.array_join("broken", ",")).agg(F.count(F.lit(1))))


def repeated_lines(spark, sf_dir):
    return C.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_references(spark, sf_dir):
    """Orders that lines name beyond those of status F, and customers without such orders."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    one = C.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey").select(F.lit("order").alias("kind"), "key")
    return one.union(C.orphans(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_custkey").select(F.lit("customer"), "key"))


def misplaced_lines(spark, sf_dir):
    """Orders of a customer whose place by key isn't that by date."""
    rows = bound(spark, sf_dir, "SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM {orders}")
    return C.misplaced(rows, ["o_custkey"], "place", ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("place").cast("long").alias("place"), "expected")


def rollout_gaps(spark, sf_dir):
    """Users that haven't acknowledged each type with a value over 40."""
    events = table(spark, sf_dir, "events")
    required = events.select("user_id").distinct().join(F.broadcast(events.select("event_type").distinct()), F.lit(True))
    return C.unacknowledged(required, events.where("value > 40"), "event_type", "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def weight_totals(spark, sf_dir):
    """Orders whose lines' quantities don't sum to 100."""
    return C.weights_total(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", 100)


QUERIES = {
    f.__name__: f
    for f in (
        stream_counts, stream_first_requests, stream_rate_limit, stream_leases, line_constraints, line_quarantine, repeated_lines, orphan_references, misplaced_lines, rollout_gaps, weight_totals,
    )
}


def _batch(name: str) -> str:
    from . import state

    return state.ORACLE[name]


ORACLE = {
    "stream_counts": """
SELECT strftime(d, '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS d FROM events)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL
""",
    "stream_first_requests": "SELECT DISTINCT user_id, event_type, event_id % 50 AS k FROM events",
    "stream_rate_limit": f"SELECT k AS bucket, o, allowed FROM ({_batch('rate_limit')})",
    "stream_leases": f"SELECT message AS user_id, o, outcome FROM ({_batch('queue_leases')})",
    "line_constraints": """
SELECT rule, count(*) AS n FROM (SELECT 'flag_known' AS rule FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT 'quantity_in_range' FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 49
  UNION ALL SELECT 'tokens_canonical' FROM lineitem WHERE l_returnflag >= l_linestatus) GROUP BY 1
""",
    "line_quarantine": "SELECT concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_tax >= 0.08 THEN 'tax' END) AS broken, count(*) AS n FROM lineitem GROUP BY 1",
    "repeated_lines": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "orphan_references": """
SELECT DISTINCT 'order' AS kind, l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')
""",
    "misplaced_lines": """
SELECT o_orderkey, place, expected FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS expected FROM orders) WHERE place <> expected
""",
    "rollout_gaps": "SELECT event_type, count(*) AS n FROM (SELECT t.event_type, u.user_id FROM (SELECT DISTINCT event_type FROM events) t, (SELECT DISTINCT user_id FROM events) u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND e.user_id = u.user_id AND e.value > 40)) GROUP BY 1",
    "weight_totals": "SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 100",
}
