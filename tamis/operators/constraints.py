"""Constraints on rows, keys, orders and references: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, ident: str, checks: dict[str, Column]) -> DataFrame:
    """(id, rule) of each check that doesn't hold; one that is null doesn't hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in checks.items()]))
    return rows.select(F.col(ident).alias("id"), F.explode(broken).alias("rule"))


def parted(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with `broken`: the quarantine."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in checks.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) != ""


def canonical(values: Column) -> Column:
    """Sorted and without repeats."""
    return values == F.array_sort(F.array_distinct(values))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Different keys of rows that no parent has."""
    return rows.select(F.col(key).alias("key")).where("key is not null").distinct().join(parents.select(F.col(parent_key).alias("key")), "key", "left_anti")


def misplaced(rows: DataFrame, by: list[str], place: str, order: list) -> DataFrame:
    """Rows whose place isn't the one that the order gives them."""
    right = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("expected", right.cast("long")).where(F.col(place) != F.col("expected"))


def unacknowledged(required: DataFrame, acks: DataFrame, group: str, member: str) -> DataFrame:
    """Required members of each group that haven't acknowledged."""
    return required.select(group, member).distinct().join(acks.select(group, member), [group, member], "left_anti")


def weights_total(rows: DataFrame, group: str, weight: str, total: int) -> DataFrame:
    return rows.groupBy(group).agg(F.sum(weight).alias("total")).where(F.col("total") != total)
