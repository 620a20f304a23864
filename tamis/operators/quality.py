"""Release and shadow metrics: rates, quantiles, gates, comparisons of responses, canary routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.similarity import div


def rate(part: Column, whole: Column) -> Column:
    """part / whole; nothing of nothing is 1."""
    return F.when(whole == 0, 1.0).otherwise(part / F.when(whole == 0, 1).otherwise(whole))


def confusion(rows: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts of true and false positives and negatives, precision and recall of each group."""
    counts = {
        "true_positive": truth & predicted,
        "false_positive": ~truth & predicted,
        "false_negative": truth & ~predicted,
        "true_negative": ~truth & ~predicted,
    }
    out = rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    tp = F.col("true_positive")
    return out.withColumns({"precision": rate(tp, tp + F.col("false_positive")), "recall": rate(tp, tp + F.col("false_negative"))})


def nearest_ranks(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Value at place int((n - 1) q + 0.5) of each group, sorted.

    Equal values are counted before they are ordered, so what a group's window
    sees is its distinct values; a null is no value.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"__end": F.sum("__k").over(order), "__n": F.sum("__k").over(Window.partitionBy(*by))})
    at = {name: F.floor((F.col("__n") - 1) * q + 0.5) for name, q in points.items()}
    hit = {name: F.max(F.when((a < F.col("__end")) & (a >= F.col("__end") - F.col("__k")), F.col(value))).alias(name) for name, a in at.items()}
    return placed.groupBy(*by).agg(F.sum("__k").alias("n"), *hit.values())


def gates(metrics: DataFrame, thresholds: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, observed, threshold, passed) of one row of metrics: each least or most that a release needs."""
    rows = F.explode(F.array(*[F.struct(F.lit(f"{how}_{m}").alias("gate"), F.col(m).cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), F.lit(how).alias("how")) for m, how, t in thresholds]))
    out = metrics.select(rows.alias("g")).select("g.*")
    passed = F.when(F.col("how") == "min", F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold"))
    return out.select("gate", "observed", "threshold", passed.alias("passed"))


def shadow(current: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """Per item: whether candidates (id, score) differ as a set or at the top, the largest change of a score, candidates lost.

    Both sides have one row a candidate; the top is the highest score, then the smaller id.
    """
    one = current.select(*key, "id", F.col("score").alias("a"))
    two = candidate.select(*key, "id", F.col("score").alias("b"))
    both = one.join(two, [*key, "id"], "full_outer")

    def top(s):
        return F.min_by("id", F.when(F.col(s).isNotNull(), F.struct((-F.col(s)).alias("s"), F.col("id").alias("i"))))

    each = both.groupBy(*key).agg(
        F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("set_changed"),
        (~top("a").eqNullSafe(top("b"))).alias("top_changed"),
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0)).alias("max_delta"),
        F.count_if(F.col("b").isNull()).alias("lost"),
    )
    return each


def shadow_summary(observed: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    out = observed.agg(
        n.alias("items"),
        F.count_if("set_changed").alias("set_changes"),
        F.count_if("top_changed").alias("top_changes"),
        F.max("max_delta").alias("max_delta"),
        F.sum("lost").alias("lost"),
    )
    items = F.greatest(F.col("items"), F.lit(1))
    return out.withColumns({"set_change_bp": div(F.col("set_changes") * 10000, items), "top_change_bp": div(F.col("top_changes") * 10000, items)})


def shadow_blockers(max_delta: int, top_bp: int, set_bp: int, lost: int) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("max_delta") > max_delta, F.lit("max_score_delta_exceeded")),
            F.when(F.col("top_change_bp") > top_bp, F.lit("top_candidate_change_rate_exceeded")),
            F.when(F.col("set_change_bp") > set_bp, F.lit("candidate_set_change_rate_exceeded")),
            F.when(F.col("lost") > lost, F.lit("coverage_loss_exceeded")),
        )
    )


def canary_bucket(ident: Column) -> Column:
    """First 8 bytes of the id's SHA-256, big-endian, modulo 10000."""
    return (F.conv(F.substring(F.sha2(ident, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 10000).cast("int")


def canary_route(ident: Column, phase: Column, basis_points: int, allowed: list[str]) -> Column:
    inside = ident.isin(*allowed) | (canary_bucket(ident) < basis_points)
    return F.when(phase == "promoted", "candidate").when((phase == "canary") & inside, "candidate").when(phase.isin("canary", "prepared", "validated", "blocked", "rolled_back"), "current")


def drift(before: Column, after: Column, failed: Column) -> Column:
    return F.when(failed, "unreproducible").when(before == after, "exact").otherwise("explainable_drift")


def alert_route(top_score: Column, blocked: Column, review_reasons: Column, clear_most: int, escalate_least: int) -> Column:
    """Escalate from a score on, unless reasons ask for review; clear up to a score without blockers; else investigate."""
    return F.when((top_score >= escalate_least) & ~blocked & ~review_reasons, "escalate").when((top_score <= clear_most) & ~blocked & ~review_reasons, "clear").otherwise("investigate")


def quorum(acks: DataFrame, by: list[str], required: int) -> DataFrame:
    """Different instances that are ready, and whether they are enough."""
    out = acks.groupBy(*by).agg(F.count_distinct(F.when(F.col("status") == "ready", F.col("instance"))).alias("ready"))
    return out.withColumn("quorum", F.col("ready") >= required)


def page(rows: DataFrame, order: list, limit: int | None = None, default: int = 100, most: int = 500) -> DataFrame:
    """A page of a list: `default` rows if no limit is asked for, `most` at most."""
    return rows.orderBy(*order).limit(min(limit or default, most))
