"""Tables from files, ready for a cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.keyspace import col


def read_tables(spark: SparkSession, paths: dict[str, str], format: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """name -> DataFrame of each path; CSV has a header and inferred types unless options say otherwise."""
    if format == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    return {name: spark.read.format(format).options(**options).load(path) for name, path in paths.items()}


def with_names(df: DataFrame, names: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """df with columns renamed, so that those to be linked share a name; keep: only these (of the old names)."""
    return df.select(*(col(c).alias(names.get(c, c)) for c in (keep or df.columns)))
