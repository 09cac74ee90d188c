"""Tables of a folder as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartomill.runtime import table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a file stream; new files beside it of the same name pattern follow."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")
