"""Versions of a catalog: difference, delta, its application and promotion; comparison and overlay of two sources.

Catalogs are DataFrames with a record id and any other columns; a record's
fingerprint is the SHA-256 of its columns as JSON.  Ids are unique and not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.similarity import div


@dataclass(frozen=True)
class PromotionPolicy:
    max_operations: int = 1000
    max_change_bp: int = 2000
    max_deletion_bp: int = 1000
    at_or_above: bool = True
    rebuild_interval: int = 0


def fingerprint(df: DataFrame, key: str, only: list[str] | None = None) -> Column:
    fields = [c for c in sorted(only or df.columns) if c != key]
    return F.sha2(F.to_json(F.struct(key, *fields), {"ignoreNullFields": "false"}), 256)


def differences(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, change, changed, before_sha256, after): one row a record; changed lists the fields that differ."""
    fields = [c for c in base.columns if c != key]
    b = base.select(F.col(key), F.struct(*fields).alias("b"), fingerprint(base, key).alias("bh"))
    t = target.select(F.col(key), F.struct(*fields).alias("t"), fingerprint(target, key, base.columns).alias("th"))
    both = b.join(t, key, "full_outer")
    kind = (
        F.when(F.col("th").isNull(), "removed").when(F.col("bh").isNull(), "added").when(F.col("bh") == F.col("th"), "unchanged").otherwise("modified")
    )
    changed = F.array_compact(F.array(*[F.when(~F.col("b")[c].eqNullSafe(F.col("t")[c]), F.lit(c)) for c in sorted(fields)]))
    none = F.array().cast("array<string>")
    return both.select(key, kind.alias("change"), F.when(kind == "modified", changed).otherwise(none).alias("changed"), F.col("bh").alias("before_sha256"), F.col("t").alias("after"))


def metrics(diff: DataFrame) -> DataFrame:
    """Totals, and changes and deletions in basis points (of the larger, and of the base catalog)."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")]
    total = diff.agg(*counts)
    base, target = F.col("removed") + F.col("modified") + F.col("unchanged"), F.col("added") + F.col("modified") + F.col("unchanged")
    most = F.greatest(base, target)

    def ratio(part, whole):
        return F.when(whole == 0, F.lit(0).cast("long")).otherwise(div(part * 10000, F.greatest(whole, F.lit(1))))

    return total.select("*", base.alias("base_records"), target.alias("target_records"), ratio(F.col("added") + F.col("removed") + F.col("modified"), most).alias("change_bp"), ratio(F.col("removed"), base).alias("deletion_bp"))


def delta(diff: DataFrame, key: str) -> DataFrame:
    """(key, operation, before_sha256, after) of all records that change."""
    op = F.when(F.col("change") == "added", "add").when(F.col("change") == "removed", "remove").when(F.col("change") == "modified", "replace")
    after = F.when(F.col("change") != "removed", F.col("after"))
    before = F.when(F.col("change") != "added", F.col("before_sha256"))
    return diff.where("change <> 'unchanged'").select(key, op.alias("operation"), before.alias("before_sha256"), after.alias("after"))


def applied(base: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """base with a delta applied.  An operation whose precondition fails is an error that stops the job."""
    fields = [c for c in base.columns if c != key]
    here = base.select(key, F.struct(*fields).alias("b"), fingerprint(base, key).alias("bh"))
    both = here.join(ops, key, "full_outer")
    op = F.col("operation")
    wrong = (
        ((op == "add") & F.col("bh").isNotNull())
        | (op.isin("replace", "remove") & ~F.col("bh").eqNullSafe(F.col("before_sha256")))
        | (op.isin("add", "replace") & F.col("after").isNull())
    )
    # the error is part of what is selected, so no optimisation drops it
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("precondition of "), op, F.lit(" fails for "), F.col(key).cast("string")))).otherwise(op)
    state = F.when(checked.isin("add", "replace"), F.col("after")).when(checked == "remove", F.lit(None)).otherwise(F.col("b"))
    return both.select(key, state.alias("s")).where("s is not null").select(key, *[F.col("s")[c].alias(c) for c in fields])


def promotion(measured: DataFrame, policy: PromotionPolicy = PromotionPolicy(), sequence: int = 1, expected: int = 1) -> DataFrame:
    """measured with outcome and reasons: a gap rejects, too much change asks for a full rebuild."""

    def over(value, most):
        return value >= most if policy.at_or_above else value > most

    ops = F.col("added") + F.col("removed") + F.col("modified")
    due = bool(policy.rebuild_interval) and sequence % policy.rebuild_interval == 0
    force = F.array_compact(
        F.array(
            F.when(ops > policy.max_operations, F.lit("operation_limit_exceeded")),
            F.when(over(F.col("change_bp"), policy.max_change_bp), F.lit("change_ratio_threshold")),
            F.when(over(F.col("deletion_bp"), policy.max_deletion_bp), F.lit("deletion_ratio_threshold")),
            F.when(F.lit(due), F.lit("periodic_full_rebuild_due")),
        )
    )
    if sequence != expected:
        return measured.withColumns({"outcome": F.lit("reject"), "reasons": F.array(F.lit("delta_sequence_gap"))})
    within = F.size(force) == 0
    return measured.withColumns(
        {
            "outcome": F.when(within, "promote_delta").otherwise("force_full_rebuild"),
            "reasons": F.when(within, F.array(F.lit("delta_within_policy"))).otherwise(force),
        }
    )


def digest(catalog: DataFrame, key: str) -> DataFrame:
    """(records, digest): one digest of all records in any order.

    Fingerprints are summed, not listed, so it is one distributed aggregation:
    two sums of 60 bits of each, in decimals.
    """
    h = fingerprint(catalog, key)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(2)]
    return catalog.agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256).alias("digest"))


def compared(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, differs): records of two sources side by side, and which fields differ."""
    one, two = left.select(key, F.struct(*fields).alias("l")), right.select(key, F.struct(*fields).alias("r"))
    both = one.join(two, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col("l")[c].eqNullSafe(F.col("r")[c]), F.lit(c)) for c in sorted(fields)]))
    linked = F.col("l").isNotNull() & F.col("r").isNotNull()
    state = (
        F.when(linked & (F.size(differs) == 0), "linked_equal").when(linked, "linked_different").when(F.col("r").isNull(), "left_only").otherwise("right_only")
    )
    return both.select(key, state.alias("state"), F.when(linked, differs).otherwise(F.array().cast("array<string>")).alias("differs"))


def overlaid(base: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """Candidates (key, score, exact, route, value, sources, attributes) of two sources: the better one wins, sources and attributes are merged.

    Of attributes that both have, the official value stands.
    """

    def side(df, p):
        return df.select(key, F.struct("score", "exact", F.col("route").alias("route"), "value").alias(f"{p}c"), F.col("sources").alias(f"{p}s"), F.col("attributes").alias(f"{p}a"))

    both = side(base, "b").join(side(official, "o"), key, "full_outer")

    def order(c, p):
        # better: higher score, exact, then the smaller route and value
        return F.struct((-F.col(f"{p}c.score")).alias("s"), (~F.col(f"{p}c.exact")).alias("e"), F.col(f"{p}c.route").alias("r"), F.col(f"{p}c.value").alias("v"))

    base_wins = F.col("oc").isNull() | (F.col("bc").isNotNull() & (order("bc", "b") <= order("oc", "o")))
    none, empty = F.array().cast("array<string>"), F.expr("cast(map() as map<string,string>)")
    bs, os = F.coalesce("bs", none), F.coalesce("os", none)
    ba, oa = F.coalesce("ba", empty), F.coalesce("oa", empty)
    own = F.map_filter(ba, lambda k, _: ~F.map_contains_key(oa, k))
    return both.select(key, F.when(base_wins, F.col("bc")).otherwise(F.col("oc")).alias("c"), F.array_sort(F.array_union(bs, os)).alias("sources"), F.map_concat(own, oa).alias("attributes")).select(
        key, "c.score", "c.exact", "c.route", "c.value", "sources", "attributes"
    )


def memberships(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, programs, active) merged by key: all programs, sorted, and whether any is active."""
    return rows.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("programs")))).alias("programs"), F.bool_or("active").alias("active"))
