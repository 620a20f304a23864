"""Folds of event streams: cases, queues, rate limits, concurrency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: from which states each action of a case may come, and where it leads (null: nowhere else)
CASE_ACTIONS = {
    "assign": (["open", "assigned", "investigating", "reopened"], "assigned"),
    "start_investigation": (["assigned", "reopened"], "investigating"),
    "request_evidence": (["assigned", "investigating", "pending_evidence"], "pending_evidence"),
    "submit_evidence": (["pending_evidence", "investigating"], "investigating"),
    "propose_decision": (["assigned", "investigating", "pending_evidence", "reopened"], "pending_approval"),
    "approve_decision": (["pending_approval"], "resolved"),
    "reject_decision": (["pending_approval"], "investigating"),
    "reopen": (["resolved"], "reopened"),
    "link_rescreen": (["open", "assigned", "investigating", "pending_evidence", "pending_approval", "reopened"], None),
}
# fixed values: state of a queued message after each action
QUEUE_STATES = {"enqueued": "pending", "recovered": "pending", "retry_scheduled": "pending", "leased": "leased", "completed": "completed", "dead": "dead"}


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with a zone or (taken as UTC) without."""
    return F.unix_micros(at.cast("timestamp"))


def case_states(events: DataFrame, case: str, order: str) -> DataFrame:
    """(case, state, assignee, proposer, revision, refused) after all events (action, actor, detail) of each case, in order.

    An action that isn't allowed from the state, an assignment to nobody, and a
    decision confirmed by the one who proposed it are refused and change nothing.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("action"), F.col("actor"), F.col("detail"))))
    none = F.lit(None).cast("string")
    zero = F.struct(F.lit("open").alias("state"), none.alias("assignee"), none.alias("proposer"), F.lit(0).alias("revision"), F.lit(0).alias("refused"))

    def step(acc, e):
        legal = F.lit(False)
        then = acc["state"]
        for action, (states, to) in CASE_ACTIONS.items():
            legal = legal | ((e["action"] == action) & acc["state"].isin(*states))
            if to:
                then = F.when(e["action"] == action, to).otherwise(then)
        closing = e["action"].isin("approve_decision", "reject_decision")
        legal = legal & ~(closing & (acc["proposer"].isNull() | acc["proposer"].eqNullSafe(e["actor"])))
        legal = legal & ~((e["action"] == "assign") & (F.trim(F.coalesce(e["detail"], F.lit(""))) == ""))
        proposer = F.when(e["action"] == "propose_decision", e["actor"]).when(e["action"].isin("reject_decision", "reopen"), none).otherwise(acc["proposer"])
        return F.struct(
            F.when(legal, then).otherwise(acc["state"]).alias("state"),
            F.when(legal & (e["action"] == "assign"), e["detail"]).otherwise(acc["assignee"]).alias("assignee"),
            F.when(legal, proposer).otherwise(acc["proposer"]).alias("proposer"),
            (acc["revision"] + legal.cast("int")).alias("revision"),
            (acc["refused"] + (~legal).cast("int")).alias("refused"),
        )

    return events.groupBy(case).agg(held.alias("es")).select(case, F.aggregate("es", zero, step).alias("s")).select(case, "s.*")


def queue_states(events: DataFrame, message: str, order: str) -> DataFrame:
    """(message, state, attempts): the last action decides; aggregated without gathering the events."""
    table = F.create_map(*[F.lit(x) for pair in QUEUE_STATES.items() for x in pair])
    last = F.max_by("action", order)
    return events.groupBy(message).agg(F.element_at(table, last).alias("state"), F.count_if(F.col("action") == "leased").alias("attempts"))


def folded(events: DataFrame, key: str, order: list[str], start, step, out: str) -> DataFrame:
    """(key, columns of out): each stream folded by step(state, event) -> (state, output tuple), in its order.

    Linear in a stream, which one task reads as Arrow batches; the same steps
    serve streams that don't end (`tamis.streaming`).
    """
    kind = events.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        state, rows = start, []
        for event in pdf.to_dict("records"):
            state, made = step(state, event)
            rows.append(made)
        made = pd.DataFrame(rows, columns=names)
        made.insert(0, key, pdf[key].to_numpy())
        return made

    return events.groupBy(key).applyInPandas(run, f"{key} {kind}, {out}")


def lease_step(lease_us: int, max_attempts: int):
    """Rules of a queue.  State: (state, lease's end, attempts); event: o, at (microseconds), action claim or complete.

    A claim takes a pending message or one whose lease has run out, at most
    max_attempts times, after which it is dead; completing needs a lease in force.
    """

    def step(state, event):
        name, until, attempts = state
        expired = name == "leased" and event["at"] >= until
        if name in ("completed", "dead"):
            return state, (event["o"], f"ignored_{name}")
        if event["action"] == "claim":
            if name == "leased" and not expired:
                return state, (event["o"], "busy")
            if attempts >= max_attempts:
                return ("dead", until, attempts), (event["o"], "dead")
            return ("leased", event["at"] + lease_us, attempts + 1), (event["o"], "leased")
        if name == "leased" and not expired:
            return ("completed", until, attempts), (event["o"], "completed")
        return state, (event["o"], "no_lease")

    return step


def bucket_step(per_minute: int, burst: int):
    """A token bucket.  State: (tokens, last time) or None; event: o, at (microseconds)."""

    def step(state, event):
        tokens, last = state or (float(burst), event["at"])
        if event["at"] > last:
            gone = event["at"] - last
            tokens = min(float(burst), tokens + (gone // 60_000_000 + gone % 60_000_000 / 60_000_000.0) * per_minute)
            last = event["at"]
        ok = tokens >= 1
        return (tokens - 1 if ok else tokens, last), (event["o"], ok)

    return step


def leases(events: DataFrame, message: str, order: str, at: str, lease_s: int, max_attempts: int) -> DataFrame:
    """(message, o, outcome) of claims and completions, by `lease_step`."""
    rows = events.select(message, F.col(order).cast("long").alias("o"), micros(F.col(at)).alias("at"), "action")
    return folded(rows, message, ["o"], ("pending", 0, 0), lease_step(lease_s * 1_000_000, max_attempts), "o long, outcome string")


def admitted(events: DataFrame, key: str, order: str, at: str, per_minute: int, burst: int) -> DataFrame:
    """(key, o, allowed): a token bucket per key, refilled with time up to burst, in order of time; nothing passes a limit of 0."""
    rows = events.select(key, F.col(order).cast("long").alias("o"), micros(F.col(at)).alias("at"))
    if per_minute <= 0 or burst <= 0:
        return rows.select(key, "o", F.lit(False).alias("allowed"))
    return folded(rows, key, ["at", "o"], None, bucket_step(per_minute, burst), "o long, allowed boolean")


def busiest(spans: DataFrame, key: list[str], start: Column, end: Column) -> DataFrame:
    """(key, most): how many half-open spans are open at once, at most; an end comes before a start of the same time."""
    marks = F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("m")
    flat = spans.select(*key, marks).groupBy(*key, "m.t").agg(F.sum("m.d").alias("d"))  # spans that end as others start cancel out
    by = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flat.withColumn("n", F.sum("d").over(by)).groupBy(*key).agg(F.max("n").alias("most"))
