"""Queries that write and read again: each sink with its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartomill.functions import text
from cartomill.functions.geo import GEOM
from cartomill.plans.base import AREA, CITY, areas, cities, query
from cartomill.runtime import table
from cartomill.sources import readers, writers


@query("k1_s2_partitions", f"SELECT areaId, countryCode, adminLevel FROM {AREA} WHERE countryCode IN ('NA', 'XK')")
def k1_s2(spark, d):
    at = writers.scratch(spark)
    writers.partitioned(areas(spark, d).select("areaId", "countryCode", "adminLevel"), at)
    return readers.partitioned(spark, at, values=["NA", "XK"]).select("areaId", "countryCode", "adminLevel")


@query("k2_unresolved", "SELECT id, countryCode FROM (SELECT DISTINCT ON (id) * FROM boundary_candidate) WHERE NOT coalesce(regexp_full_match(countryCode, '[A-Z]{2}'), false)")
def k2(spark, d):
    at = writers.scratch(spark)
    rows = table(spark, d, "boundary_candidate").dropDuplicates(["id"]).select("id", "countryCode")
    writers.unresolved(rows, at, "countryCode", "countryCode", "id")
    return readers.parquet(spark, at, "id string, countryCode string")


@query("k4_s7_feature_lines", f"SELECT areaId, nameLocal, len(geometry)::INT AS polygons, round(geometry[1][1][1].x, 9) AS first_x FROM {AREA} WHERE geometry IS NOT NULL")
def k4_s7(spark, d):
    at = writers.scratch(spark)
    writers.feature_lines(areas(spark, d).where("geometry IS NOT NULL").select("areaId", "nameLocal", "geometry"), at)
    schema = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    f = readers.json_lines(spark, at, schema, strict=True)
    g = readers.geometry_of(F.col("geometry.type"), F.col("geometry.coordinates"))
    return f.select(F.col("properties")["areaId"].alias("areaId"), F.col("properties")["nameLocal"].alias("nameLocal"), g.alias("g")).select(
        "areaId", "nameLocal", F.size("g").alias("polygons"), F.round(F.col("g")[0][0][0]["x"], 9).alias("first_x")
    )


@query("k5_canonical_json", f"SELECT areaId, '{{\"areaId\":\"' || areaId || '\",\"nested\":{{\"country\":\"' || countryCode || '\",\"level\":' || CASE WHEN adminLevel IS NULL THEN 'null' ELSE '\"' || adminLevel || '\"' END || '}}}}' AS line FROM {AREA}")
def k5(spark, d):
    """Keys of the row and of the object in it come in order, whatever order they have."""
    a = areas(spark, d).select(F.struct(F.col("adminLevel").alias("level"), F.col("countryCode").alias("country")).alias("nested"), "areaId")
    return a.select("areaId", writers.canonical_json(a).alias("line"))


@query("s4_cities_tsv", "SELECT try_cast(f[1] AS bigint) AS id, f[2] AS name, f[9] AS countryCode, try_cast(nullif(f[15], '') AS bigint) AS population FROM (SELECT string_split(record, chr(9)) f FROM city_raw WHERE feed = 'cities500') WHERE len(f) = 19 AND regexp_full_match(f[1], '[0-9]{1,38}') AND try_cast(f[1] AS hugeint) <= 9007199254740991 AND (f[15] = '' OR regexp_full_match(f[15], '[0-9]{1,38}') AND try_cast(f[15] AS hugeint) <= 9007199254740991) AND f[2] <> '' AND f[3] <> '' AND f[9] <> '' AND coalesce(try_cast(f[5] AS double) BETWEEN -90 AND 90 AND try_cast(f[6] AS double) BETWEEN -180 AND 180, false)")
def s4_all(spark, d):
    """All rows the reader takes: it fails on any other."""
    at = writers.scratch(spark)
    f = F.split("record", "\t", -1)
    field = lambda i: F.get(f, F.lit(i))
    good = table(spark, d, "city_raw").where("feed = 'cities500'").where((F.size(f) == 19) & text.is_whole(field(0)) & ((field(14) == "") | text.is_whole(field(14))) & (field(1) != "") & (field(2) != "") & (field(8) != "")
        & F.coalesce(field(4).try_cast("double").between(-90, 90) & field(5).try_cast("double").between(-180, 180), F.lit(False)))
    good.select(F.regexp_replace("record", "[\r\n]", "").alias("value")).write.mode("overwrite").text(at)
    return readers.cities_tsv(spark, at).select("id", "name", "countryCode", "population")


@query("s5_alternate_names", f"SELECT id AS cityId, 'zh' AS language, zhName AS name, id % 2 = 1 AS is_preferred FROM {CITY} WHERE zhName IS NOT NULL")
def s5(spark, d):
    """A file of Chinese and other names, written and read again."""
    at = writers.scratch(spark)
    line = lambda lang, name: F.concat_ws("\t", F.lit("1"), F.col("id").cast("string"), F.lit(lang), F.regexp_replace(name, "[\t\r\n]", " "), F.when(F.col("id") % 2 == 1, "1").otherwise(""), F.lit(""), F.lit(""), F.lit(""))
    c = cities(spark, d)
    lines = c.where("zhName IS NOT NULL").select(line("zh", F.col("zhName")).alias("value")).unionByName(c.where("name IS NOT NULL").select(line("en", F.col("name")).alias("value")))
    lines.write.mode("overwrite").text(at)
    return readers.alternate_names(spark, at).select("cityId", "language", "name", "is_preferred")


@query("s6_country_info", "SELECT countryCode, continentCode FROM country_info")
def s6(spark, d):
    at = writers.scratch(spark)
    fields = F.concat_ws("\t", F.col("countryCode"), *[F.lit("x")] * 7, F.col("continentCode"))
    table(spark, d, "country_info").select(F.explode(F.array(F.concat(F.lit("# "), fields), fields)).alias("value")).write.mode("overwrite").text(at)
    return readers.country_info(spark, at)


@query("s8_identity_lines", f"SELECT areaId AS divisionId, sourceId AS hash, CASE WHEN length(areaId) % 5 = 0 THEN 'LINE_INVALID' END AS code FROM {AREA} WHERE length(areaId) % 5 <> 0 UNION ALL SELECT NULL, NULL, 'LINE_INVALID' FROM {AREA} WHERE length(areaId) % 5 = 0")
def s8(spark, d):
    at = writers.scratch(spark)
    line = F.to_json(F.struct(F.col("areaId").alias("divisionId"), F.col("sourceId").alias("hash")))
    areas(spark, d).select(F.when(F.length("areaId") % 5 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.mode("overwrite").text(at)
    rows = readers.json_lines(spark, at, "divisionId string, hash string")
    return rows.select("divisionId", "hash", F.when(F.col("_corrupt").isNotNull(), "LINE_INVALID").alias("code"))


@query("s11_manifest", "SELECT packageId AS key, countryCode, boundaryVersion, featureCount, byteSize FROM country_manifest WHERE boundaryRelease = '2026-06-17.0' QUALIFY row_number() OVER (PARTITION BY packageId ORDER BY loadedAt DESC) = 1")
def s11(spark, d):
    """One JSON object a country, so that none grows with the table."""
    cols = ["schemaVersion", "countryCode", "boundaryVersion", "featureCount", "byteSize", "checksum", "updatedAt"]
    m = table(spark, d, "country_manifest").where("boundaryRelease = '2026-06-17.0'").groupBy("packageId").agg(F.max_by(F.struct(*cols), "loadedAt").alias("e"))
    text = m.groupBy("packageId").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("packageId", "e")))).alias("text"))
    return readers.manifest(text).select("key", "countryCode", "boundaryVersion", "featureCount", "byteSize")


@query("s14_s15_files", f"SELECT countryCode AS folder, sum(octet_length(encode(areaId)) + 1)::BIGINT AS byteSize, sha256(string_agg(areaId, chr(10) ORDER BY areaId) || chr(10)) AS sha256 FROM {AREA} GROUP BY countryCode")
def s14_s15(spark, d):
    """One file a country, listed with size and digest; the codes come from the folders' names."""
    at = writers.scratch(spark)
    areas(spark, d).select("areaId", "countryCode").repartition("countryCode").sortWithinPartitions("countryCode", "areaId").write.mode("overwrite").partitionBy("countryCode").text(at)
    return readers.files(spark, at, "part-*", content=True).select("folder", "byteSize", "sha256")


@query("s3_listed_files", f"SELECT areaId, countryCode FROM {AREA}")
def s3(spark, d):
    at = writers.scratch(spark)
    areas(spark, d).select("areaId", "countryCode").write.mode("overwrite").parquet(at)
    paths = [f"{at}/{r.name}" for r in readers.files(spark, at, "part-*").select("name").collect()]  # files of one write
    return readers.listed(spark, paths, "areaId string, countryCode string", 1 << 40)


@query("s9_feature_collection", f"SELECT countryCode AS code, areaId, nameLocal, len(geometry)::INT AS polygons FROM {AREA} WHERE geometry IS NOT NULL")
def s9(spark, d):
    """A collection a country, one document each, read again as features."""
    at = writers.scratch(spark)
    c = F.transform("geometry", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("areaId", "nameLocal", F.col("countryCode").alias("code")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), c.alias("coordinates")).alias("geometry"))
    a = areas(spark, d).where("geometry IS NOT NULL").groupBy("countryCode", F.pmod(F.xxhash64("areaId"), F.lit(64)).alias("part")).agg(F.collect_list(feature).alias("features"))
    # documents in parts of a country, so that none grows with it
    a.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"), "countryCode", "part").repartition("countryCode", "part").write.mode("overwrite").partitionBy("countryCode", "part").text(at)
    f = readers.feature_collection(spark, at)
    g = readers.geometry_of(F.col("kind"), F.col("coordinates"))
    return f.select(F.col("properties")["code"].alias("code"), F.col("properties")["areaId"].alias("areaId"), F.col("properties")["nameLocal"].alias("nameLocal"), F.size(g).alias("polygons"))


@query("s12_v20_area_index", f"WITH r AS (SELECT 'area' AS kind, areaId, countryCode, CASE WHEN nameZh IS NULL THEN 'old' ELSE 'new' END AS v FROM city_area), c AS (SELECT DISTINCT countryCode FROM country_info WHERE countryCode < 'XM') SELECT areaId, CASE WHEN count(*) OVER (PARTITION BY areaId) > 1 THEN 'DUPLICATE_IDENTITY' WHEN c.countryCode IS NULL THEN 'COUNTRY_MISSING' WHEN v <> 'new' THEN 'VERSION_MISMATCH' WHEN NOT starts_with(areaId, countryCode || ':') THEN 'ID_COUNTRY_MISMATCH' END AS code FROM r LEFT JOIN c USING (countryCode)")
def s12(spark, d):
    """An index of some countries and all areas, written as JSON and read as records of two kinds."""
    at = writers.scratch(spark)
    none = F.lit(None).cast("string")
    a = table(spark, d, "city_area").select(F.lit("area").alias("kind"), "countryCode", F.when(F.col("nameZh").isNull(), "old").otherwise("new").alias("boundaryVersion"), "areaId", "adminLevel", "nameZh", "nameLocal", "aliases")
    c = table(spark, d, "country_info").select("countryCode").distinct().where("countryCode < 'XM'").select(F.lit("country").alias("kind"), "countryCode", F.lit("new").alias("boundaryVersion"), *[none.alias(k) for k in ("areaId", "adminLevel", "nameZh")], F.col("countryCode").alias("nameLocal"), F.array().cast("array<string>").alias("aliases"))
    writers.json_lines(c.unionByName(a), at)
    schema = "kind string, countryCode string, boundaryVersion string, areaId string, adminLevel string, nameZh string, nameLocal string, aliases array<string>"
    return readers.index_codes(readers.json_lines(spark, at, schema, strict=True)).where("kind = 'area'").select("areaId", "code")


@query("s13_bounded_json", "SELECT countryCode, countryName, continentCode FROM country_info")
def s13(spark, d):
    at = writers.scratch(spark)
    table(spark, d, "country_info").select(F.to_json(F.struct("countryName", "continentCode", "countryCode")).alias("value"), F.col("countryCode").alias("c")).repartition("c").write.mode("overwrite").partitionBy("c").text(at)
    return readers.bounded_json(spark, at, "countryCode string, countryName string, continentCode string", 1 << 20).drop("name")


@query("k2_k8_snapshot_metadata", "SELECT countryCode AS code, count(*) AS n, (SELECT count(*) FROM boundary_candidate WHERE regexp_full_match(countryCode, '[A-Z]{2}')) AS total, (SELECT count(*) FROM boundary_candidate WHERE NOT coalesce(regexp_full_match(countryCode, '[A-Z]{2}'), false)) AS unresolved FROM boundary_candidate WHERE regexp_full_match(countryCode, '[A-Z]{2}') GROUP BY 1")
def k8(spark, d):
    m = writers.snapshot_metadata(table(spark, d, "boundary_candidate"))
    return m.select(F.explode("rowCounts").alias("code", "n"), "total", "unresolved")


@query("k3_json_array", "SELECT countryCode, countryName FROM country_info")
def k3(spark, d):
    at = writers.scratch(spark)
    writers.json_array(table(spark, d, "country_info").select("countryName", "countryCode"), at, "countryCode")
    return readers.records(spark, at, "countryCode string, countryName string")


@query("k10_manifest_parity", f"SELECT countryCode, 'COUNT_MISMATCH' AS code FROM (SELECT countryCode, count(*) n, count(*) FILTER (geometry IS NOT NULL) m FROM {AREA} GROUP BY 1) WHERE n <> m UNION ALL SELECT DISTINCT countryCode, 'ID_MISMATCH' FROM {AREA} WHERE geometry IS NULL")
def k10(spark, d):
    """Index and manifest of all areas against packages of those that have a geometry."""
    a = areas(spark, d)
    manifest, index = writers.manifest_and_index(a.select("countryCode", "areaId", "nameZh", "nameLocal", "aliases", "adminLevel", "geometry"), "v")
    return writers.parity(index, manifest, a.where("geometry IS NOT NULL").select("countryCode", "areaId"))


@query("s8_duplicate_lines", "SELECT areaId AS divisionId, CASE WHEN row_number() OVER (PARTITION BY areaId) > 1 THEN 'DIVISION_ID_DUPLICATE' END AS code FROM city_area")
def s8_twice(spark, d):
    at = writers.scratch(spark)
    table(spark, d, "city_area").select(F.to_json(F.struct(F.col("areaId").alias("divisionId"), F.col("sourceId").alias("geometryHash"))).alias("value")).write.mode("overwrite").text(at)
    return readers.identities(spark, at).select("divisionId", "code")


@query("s19_k16_backup", "SELECT countryCode AS code, countryName AS note, '2026-01-01T00:00:00.000Z' AS updatedAt FROM country_info")
def s19_k16(spark, d):
    """A backup document written and parsed again."""
    visit = table(spark, d, "country_info").select(F.ascii("countryCode").cast("bigint").alias("cityId"), F.lit("2026-01-01T00:00:00.000Z").alias("updatedAt"), F.concat_ws("|", "countryCode", "countryName").alias("note"))
    none = spark.createDataFrame([], "cityId bigint, source string")
    doc = writers.backup_document(visit, none, "t", "2026-01-01T00:00:00.000Z")
    part = lambda i: F.split_part("note", F.lit("|"), F.lit(i))
    return readers.backup(doc)["visits"].select(part(1).alias("code"), part(2).alias("note"), "updatedAt")


@query("a21_checksum")
def a21(spark, d):
    a = areas(spark, d).select("areaId", "countryCode", "nameLocal")
    return writers.checksum(a, "areaId")
