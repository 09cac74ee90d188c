"""Registration of queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.runtime import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the shared views.
CITY = "(SELECT DISTINCT ON (id) * FROM city_summary)"
AREA = "(SELECT DISTINCT ON (areaId) * FROM city_area)"
CAND = "(SELECT DISTINCT ON (id) * FROM boundary_candidate)"
USABLE = "(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon))"
LATEST = "2026-06-17.0"
BEFORE = "2026-05-20.0"


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that must give the same rows."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # Arrow functions are pickled by reference
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def cities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_summary").dropDuplicates(["id"])


def areas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_area").dropDuplicates(["areaId"])


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "boundary_candidate").dropDuplicates(["id"])


def release(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The rows of one delivery that count: the latest of each area."""
    t = table(spark, d, "area_snapshot").where(F.col("boundaryRelease") == name)
    cols = [c for c in t.columns if c not in ("areaId", "loadedAt")]
    return t.groupBy("areaId").agg(F.max_by(F.struct(*cols), "loadedAt").alias("r")).select("areaId", "r.*")


def release_sql(name: str) -> str:
    return f"(SELECT * FROM area_snapshot WHERE boundaryRelease = '{name}' QUALIFY row_number() OVER (PARTITION BY areaId ORDER BY loadedAt DESC) = 1)"
