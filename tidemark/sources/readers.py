"""Source readers. Paths go to Spark's readers untouched, so any filesystem Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | None = None) -> DataFrame:
    """One-off conversion; give a schema to keep leading zeros in codes."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(source) if schema is not None else reader.option("inferSchema", True).csv(source)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)
