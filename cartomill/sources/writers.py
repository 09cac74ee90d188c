"""Writers of every output format."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill import runtime
from cartomill.functions import text
from cartomill.sources import readers


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share."""
    runtime.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def partitioned(df: DataFrame, path: str, key: str = "countryCode", rows_per_file: int = 1_000_000) -> None:
    """Hive partitions, ZSTD; keys that are no two capitals are left to unresolved().

    Rows go to tasks by key and a hash part, so a frequent key is written by several
    tasks and a rare one by few.
    """
    df.where(F.col(key).rlike(r"\A[A-Z]{2}\z")).repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option(
        "compression", "zstd"
    ).option("maxRecordsPerFile", rows_per_file).partitionBy(key).parquet(path)


def unresolved(df: DataFrame, path: str, key: str, *order: str) -> None:
    """K2: the rows of other keys, null ones too, in order."""
    df.where(~F.coalesce(F.col(key).rlike(r"\A[A-Z]{2}\z"), F.lit(False))).orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """K4: one object a line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def feature_lines(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """K4: GeoJSON features, one a line."""
    coordinates = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    properties = F.struct(*[c for c in df.columns if c != geometry])
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def canonical_json(df: DataFrame) -> Column:
    """K5: text of a row with the keys of all its objects in order, nested ones too; nulls are written."""
    return text.canonical_text(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def json_array(df: DataFrame, path: str, *order: str) -> None:
    """K3: one file of a JSON array, rows in order; for tables of a bounded size (a report, an index), as one task writes it.

    An empty table is an empty array.
    """
    rows = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], canonical_json(df).alias("json")).alias("r"))
    one = rows.groupBy().agg(F.array_sort(F.collect_list("r")).alias("r"))
    one.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """K2, K8: (files, bytes, sha256) of what was written to a folder; the digest is of the files' digests in order."""
    f = readers.files(spark, path, "part-*", content=True)
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("byteSize"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("sha256"))


def snapshot_metadata(df: DataFrame, key: str = "countryCode") -> DataFrame:
    """K8: one row: rowCounts by code, total of coded rows, unresolved rows; the counts add up to the total by construction."""
    code = F.when(F.col(key).rlike(r"\A[A-Z]{2}\z"), F.col(key))
    counts = df.groupBy(code.alias("code")).agg(F.count("*").alias("n"))  # one row a code
    coded = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n")))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counts.agg(F.map_from_entries(F.array_sort(coded)).alias("rowCounts"), n(F.col("code").isNotNull()).alias("total"), n(F.col("code").isNull()).alias("unresolved"))


def manifest_and_index(features: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, index) of features (countryCode, areaId, nameZh, nameLocal, aliases, adminLevel, geometry).

    manifest: countryCode, boundaryVersion, featureCount, checksum (of the features' texts
    in order of their ids, as a tree of digests by country); index: one row an area.
    """
    digest = F.sha2(canonical_json(features), 256)
    one = features.select("countryCode", "areaId", digest.alias("h"))
    # parts of a country are digested apart, so that no task holds more than a share of it
    part = F.pmod(F.xxhash64("areaId"), F.lit(1024))
    join = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), "\n"), 256)
    parts = one.groupBy("countryCode", part.alias("part")).agg(F.count("*").alias("n"), join(F.struct("areaId", "h")).alias("h"))
    manifest = parts.groupBy("countryCode").agg(F.sum("n").alias("featureCount"), join(F.struct("part", "h")).alias("checksum")).withColumn("boundaryVersion", F.lit(version))
    return manifest, features.select("countryCode", "areaId", "nameZh", "nameLocal", "aliases", "adminLevel", F.lit(version).alias("boundaryVersion"))


def parity(index: DataFrame, manifest: DataFrame, packages: DataFrame) -> DataFrame:
    """(countryCode, code) of countries whose index, manifest and packages (countryCode, areaId) do not say the same."""
    n = lambda df, name: df.groupBy("countryCode").agg(F.countDistinct("areaId").alias(name))
    counts = manifest.select("countryCode", F.col("featureCount").alias("m")).join(n(index, "i"), "countryCode", "full").join(n(packages, "p"), "countryCode", "full")
    same = F.coalesce((F.col("m") == F.col("i")) & (F.col("m") == F.col("p")), F.lit(False))
    packed = packages.select(F.col("countryCode").alias("_c"), F.col("areaId").alias("_a")).distinct()
    ids = index.select("countryCode", "areaId").distinct()
    apart = ids.join(packed, (F.col("countryCode") == F.col("_c")) & (F.col("areaId") == F.col("_a")), "left_anti").select("countryCode")
    return counts.where(~same).select("countryCode", F.lit("COUNT_MISMATCH").alias("code")).unionByName(apart.distinct().select("countryCode", F.lit("ID_MISMATCH").alias("code")))


def backup_document(visits: DataFrame, boundaries: DataFrame, title: str, exported_at: str, most: int = 10_000) -> DataFrame:
    """One row ``document`` of visits and boundaries in order of cityId; more than ``most`` of either fail, as a backup is bounded."""
    def listed(df, name):
        rows = df.limit(most + 1).agg(F.array_sort(F.collect_list(F.struct("cityId", *[c for c in df.columns if c != "cityId"]))).alias(name))
        return rows.where(F.when(F.size(name) > most, F.raise_error(F.lit(f"too many {name}"))).otherwise(True))

    both = listed(visits, "visits").crossJoin(listed(boundaries, "boundaries"))  # one row each
    whole = F.struct(F.lit(1).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt"), F.lit(title).alias("title"), "visits", "boundaries")
    return both.select(F.to_json(whole).alias("document"))


def document(value, path: str) -> None:
    """A small JSON document, keys in order, written beside and renamed."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "x", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n")
    os.replace(part, path)


def promote(staged: dict[str, str]) -> None:
    """K7: several staged folders take their places together; all go back if one fails."""
    done: list[tuple[str, str | None]] = []
    try:
        for source, target in staged.items():
            kept = None
            if os.path.exists(target):
                kept = f"{target}.{uuid.uuid4().hex}.kept"
                os.replace(target, kept)
            done.append((target, kept))
            os.replace(source, target)
    except OSError:
        for target, kept in reversed(done):
            if kept:
                if os.path.exists(target):
                    os.replace(target, f"{target}.{uuid.uuid4().hex}.failed")
                os.replace(kept, target)
        raise
    import shutil

    for _, kept in done:
        if kept:
            shutil.rmtree(kept, ignore_errors=True)


def checksum(df: DataFrame, *order: str, rows_per_digest: int = 50_000, fan: int = 4096) -> DataFrame:
    """Rows and one SHA-256 of all rows in order, as a tree of digests.

    Rows are hashed into buckets of their keys by how many there are, each bucket's rows
    in order; digests are then joined by at most ``fan`` at a time. No task holds more
    than a bucket or ``fan`` digests. An empty table has 0 rows and the digest of nothing.
    """
    total = df.count()
    parts = max(1, -(-total // rows_per_digest))
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.sha2(canonical_json(df), 256).alias("h"))
    level = df.select(F.pmod(F.xxhash64(*order), F.lit(parts)).alias("b"), row.alias("r")).groupBy("b").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda s: s["h"]), "\n"), 256).alias("h")
    )
    while True:
        up = F.floor(F.col("b") / fan).alias("b") if parts > fan else F.lit(0).cast("bigint").alias("b")
        level = level.select(up, F.struct("b", "h").alias("r")).groupBy("b").agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda s: s["h"]), "\n"), 256).alias("h")
        )
        if parts <= fan:
            break
        parts = -(-parts // fan)
    digest = F.coalesce(F.max("h"), F.sha2(F.lit(""), 256))
    return level.agg(digest.alias("checksum")).select(F.lit(total).cast("bigint").alias("rows"), "checksum")
