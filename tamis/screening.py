"""Screening queries over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.text import text_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookup of normalised part names: for each name, how many records carry it and the first."""
    part = table(spark, sf_dir, "part").select("p_partkey", text_key(F.col("p_name")).alias("name_key"))
    return part.groupBy("name_key").agg(F.count("*").alias("n_records"), F.min("p_partkey").alias("first_record"))


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a country, ranked by balance then id; the 20 best of each."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    by = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), F.asc("s_suppkey"))
    return supplier.withColumn("rank", F.row_number().over(by)).where("rank <= 20").select(
        "s_nationkey", "s_suppkey", F.col("rank").cast("long").alias("rank")
    )


def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of each customer effective at 1997-01-01 (the largest key on a tie)."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1997-01-01").cast("date"))
    return orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("order_key")
    )


QUERIES = {f.__name__: f for f in (name_lookup, candidate_rank, as_of_orders)}

ORACLE = {
    "name_lookup": """
SELECT trim(regexp_replace(upper(coalesce(p_name, '')), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS name_key,
       count(*) AS n_records, min(p_partkey) AS first_record FROM part GROUP BY 1
""",
    "candidate_rank": """
SELECT s_nationkey, s_suppkey, rank FROM (
  SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank
  FROM supplier) WHERE rank <= 20
""",
    "as_of_orders": """
SELECT o_custkey, order_key FROM (
  SELECT o_custkey, o_orderkey AS order_key,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderdate <= DATE '1997-01-01') WHERE r = 1
""",
}
