"""Tables of a folder, and bindings of them that Spark and DuckDB read from one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """A read table with each row's `place`: its file, and where it stands there.  SQL that leaves a tie open takes the first."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()


def bound(spark: SparkSession, sf_dir: str, binding: str, places: str = "") -> DataFrame:
    """A binding (SQL with {table} names) over the folder's tables: it gives an operator's input, never its result.

    The table named by `places` has a column `place` besides.
    """
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in binding}
    used = {t: placed(df) if t == places else df for t, df in used.items()}
    return spark.sql(binding, **used)


def sql(binding: str) -> str:
    """The same binding for DuckDB, where the tables are views."""
    for t in TABLES:
        binding = binding.replace("{" + t + "}", t)
    return binding
