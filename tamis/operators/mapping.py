"""Effective-dated mappings of list names, pointers to active versions, and their timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_at(requests: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str) -> DataFrame:
    """requests with the version of their key that has the greatest start up to `at`, or nulls.

    versions have one row a (key, start).  Both sides go to one order by key
    and time, in which the last version seen is carried to each request: linear
    in both, where a join would list all earlier versions of each request.
    Null keys match nothing.
    """
    fields = [c for c in versions.columns if c != key]
    one = versions.select(F.col(key), F.col(valid_from).alias("__t"), F.lit(0).alias("__o"), F.struct(*fields).alias("__v"), F.lit(None).cast(requests.select(F.struct("*")).schema[0].dataType).alias("__r"))
    two = requests.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__o"), F.lit(None).cast(one.schema["__v"].dataType).alias("__v"), F.struct("*").alias("__r"))
    so_far = Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = one.unionByName(two).withColumn("__v", F.last("__v", ignorenulls=True).over(so_far)).where("__o = 1")
    return both.select("__r.*", F.when(F.col(key).isNotNull(), F.col("__v")).alias("version"))


def resolution(known: Column, version: Column, at: Column, component: Column, pointer: Column) -> Column:
    """Status of a request, by the first check that fails.

    version: struct (effective_to, action); component: its status, null if it
    is missing; pointer: the active version's id.
    """
    return (
        F.when(~known, "unmapped")
        .when(version.isNull(), "not_effective")
        .when(version["effective_to"].isNotNull() & (at >= version["effective_to"]), "expired")
        .when(version["action"] == "retire", "retired")
        .when(component.isNull(), "component_missing")
        .when(component != "active", "component_retired")
        .when(pointer.isNull(), "catalog_not_active")
        .otherwise("resolved")
    )


def timeline_faults(versions: DataFrame, key: str, number: str, valid_from: str, ident: str, supersedes: str) -> DataFrame:
    """versions with `fault`: a start that doesn't advance, or a version that doesn't supersede the one before; null if sound."""
    order = Window.partitionBy(key).orderBy(number)
    before, start = F.lag(ident).over(order), F.lag(valid_from).over(order)
    fault = F.when(start.isNotNull() & (F.col(valid_from) <= start), "start_not_advancing").when(~F.col(supersedes).eqNullSafe(before), "supersedes_mismatch")
    return versions.withColumn("fault", fault)


def activations(events: DataFrame, key: str, order: str, version: str, expected: str) -> DataFrame:
    """events with epoch (1, 2, ...) and verdict: an activation holds if it expects the version that was active before it."""
    by = Window.partitionBy(key).orderBy(order)
    before = F.lag(version).over(by)
    return events.withColumns({"epoch": F.row_number().over(by).cast("long"), "verdict": F.when(F.col(expected).eqNullSafe(before), "ok").otherwise("conflict")})


def inventory_changes(old: DataFrame, new: DataFrame, renames: DataFrame, key: str, count: str) -> DataFrame:
    """(key, change, renamed_from, delta_percent) between two inventories; a rename joins a removed name to an added one."""
    b = old.select(F.col(key).alias("old_key"), F.col(count).alias("before"))
    moved = b.join(renames.toDF("old_key", "new_key"), "old_key", "left").withColumn(key, F.coalesce("new_key", "old_key"))
    both = moved.join(new.select(key, F.col(count).alias("after")), key, "full_outer")
    change = (
        F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("old_key") != F.col(key), "renamed").otherwise("unchanged")
    )
    diff = F.abs(F.col("after") - F.col("before"))
    percent = F.when(F.col("before") == 0, F.when(F.col("after") == 0, 0.0).otherwise(100.0)).otherwise(F.round(diff / F.nullif("before", F.lit(0)) * 1e6) / 1e4)
    return both.select(key, change.alias("change"), F.when(change == "renamed", F.col("old_key")).alias("renamed_from"), percent.alias("delta_percent"))
