"""Named queries of the core, each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartomill.operators import nearby, record_checks, snapshot_changes
from cartomill.operators import oracles
from cartomill.plans import function_queries, io_queries, relational_queries  # noqa: F401  (they register)
from cartomill.plans.base import ORACLES, QUERIES, USABLE, query
from cartomill.runtime import table

@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes.found(table(spark, d, "area_snapshot"), table(spark, d, "country_manifest"))


_KM = relational_queries.KM
_CITY = f"(SELECT DISTINCT id, lat, lon FROM city_summary WHERE {USABLE})"


@query("p3_found", f"""
SELECT 'near' AS relation_kind, a.id AS city_id, b.id::VARCHAR AS other_key FROM {_CITY} a JOIN {_CITY} b ON a.id < b.id AND abs(a.lat - b.lat) < 0.03
WHERE {_KM.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon")} <= 3
UNION ALL SELECT 'inside', city_id, areaId FROM ({relational_queries.RAYCAST})
UNION ALL SELECT DISTINCT 'centre', a.id, b.areaId FROM {_CITY} a JOIN city_area b ON abs(a.lat - b.centroid.y) < 0.02
WHERE {_KM.format(lat1="a.lat", lon1="a.lon", lat2="b.centroid.y", lon2="b.centroid.x")} <= 1.5
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearby.found(table(spark, d, "city_summary"), table(spark, d, "city_area"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return record_checks.rejected(table(spark, d, "city_raw"), table(spark, d, "country_info"))


@query("p4_loaded")
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return record_checks.loaded(table(spark, d, "city_raw"), table(spark, d, "country_info"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLES | oracles.ORACLES).items() if k in QUERIES}
