"""Readers of every input format, always under an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartomill.functions import text
from cartomill.functions.geo import GEOM, RING, arc_points
from cartomill.operators.relational import assert_unique

#: The columns of the tab-separated gazetteer files.
CITIES_500 = "id,name,asciiName,aliases,lat,lon,featureClass,featureCode,countryCode,cc2,admin1,admin2,admin3,admin4,population,elevation,dem,timezone,modified".split(",")
ALTERNATE_NAMES = "alternateId,cityId,language,name,isPreferred,isShort,isColloquial,isHistoric".split(",")
COUNTRY_INFO = "code,iso3,isoNumeric,fips,country,capital,areaKm2,population,continent".split(",")
CONTINENTS = ("AF", "AN", "AS", "EU", "NA", "OC", "SA")


def parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One folder or glob; the leaf folder itself, so that no partition column is inferred."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def partitioned(spark: SparkSession, root: str, key: str = "countryCode", values: list[str] | None = None) -> DataFrame:
    """Hive partitions, keys as text; only the folders of the values asked for are read."""
    key_name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key_name)
    spark.conf.set(key_name, "false")
    try:
        df = spark.read.option("basePath", root).parquet(root)
    finally:
        spark.conf.set(key_name, before)
    return df.where(F.col(key).isin(values)) if values is not None else df


def _tsv(spark: SparkSession, path: str, columns: list[str], exact: bool) -> DataFrame:
    """Lines split at tabs, quotes are ordinary; with exact, another number of fields fails the query.

    The CSV reader fills short rows with nulls and takes empty text for null, so lines
    are split here.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    rows = lines.select("value", F.split("value", "\t", -1).alias("f"))
    if exact:
        rows = rows.where(
            F.when(F.size("f") != len(columns), F.raise_error(F.concat(F.lit("bad row: "), F.col("value")))).otherwise(True)
        )
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def cities_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Typed gazetteer rows. NA is a country, never null.

    A row of another number of fields, without id, name or country, with an id or
    population that is no whole number a double holds, or off the globe fails the query,
    with its text.
    """
    checked = _tsv(spark, path, CITIES_500, exact=True)
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    inside = F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    right = inside & text.is_whole(F.col("id")) & (F.col("name") != "") & (F.col("asciiName") != "") & (F.col("countryCode") != "") & ((F.col("population") == "") | text.is_whole(F.col("population")))
    says = F.concat(F.lit("invalid required value: "), F.concat_ws("\t", "id", "name", "countryCode", "lat", "lon", "population"))
    return checked.where(F.when(~right, F.raise_error(says)).otherwise(True)).select(
        F.col("id").cast("bigint").alias("id"), "name", "asciiName",
        F.split(F.nullif(F.col("aliases"), F.lit("")), ",").alias("aliases"),
        lat.alias("lat"), lon.alias("lon"), "countryCode", "admin1",
        F.nullif("population", F.lit("")).cast("bigint").alias("population"),
    )


def listed(spark: SparkSession, paths: list[str], schema: str, most_bytes: int) -> DataFrame:
    """S3: exactly these parquet files, one at least; missing ones, and more than most_bytes in all, fail before any is read."""
    if not paths:
        raise ValueError("no files are listed")
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(p)
        total += fs.getContentSummary(path).getLength()
    if total > most_bytes:
        raise ValueError(f"{total} bytes are listed, {most_bytes} are allowed")
    return spark.read.schema(schema).parquet(*paths)


def bounded_json(spark: SparkSession, path: str, schema: str, most_bytes: int) -> DataFrame:
    """JSON documents of a folder, whole files; one that is larger, empty, not UTF-8, with a byte order mark, or no document of the schema fails."""
    # the scan leaves out files without a byte: a listing, of some documents, finds them
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while found.hasNext():
        one = found.next()
        if one.getLen() == 0 and not one.getPath().getName().startswith(("_", ".")):
            raise ValueError(f"empty: {one.getPath()}")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bad = lambda says: F.raise_error(F.concat(F.lit(says), F.col("path")))
    mark = F.substring(F.hex("content"), 1, 6) == "EFBBBF"
    good = f.where(F.when(F.col("length") > most_bytes, bad("too large: ")).when(mark, bad("byte order mark: ")).when(~F.is_valid_utf8(F.col("content").cast("string")), bad("not UTF-8: ")).otherwise(True))
    return good.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"}).alias("d")).select("name", "d.*")


def identities(spark: SparkSession, path: str) -> DataFrame:
    """(divisionId, geometryHash, code) of identity lines: LINE_INVALID, DIVISION_ID_DUPLICATE after the first valid one, or null.

    The first is that of the file read first, at the least position in it.
    """
    raw = json_lines(spark, path, "divisionId string, geometryHash string")
    bad = F.col("_corrupt").isNotNull() | F.col("divisionId").isNull() | F.col("geometryHash").isNull()
    w = Window.partitionBy("divisionId").orderBy("_at")
    marked = raw.select("*", F.monotonically_increasing_id().alias("_at"), bad.alias("_bad"))
    valid = marked.where("NOT _bad").withColumn("_rn", F.row_number().over(w))
    return valid.select("divisionId", "geometryHash", F.when(F.col("_rn") > 1, "DIVISION_ID_DUPLICATE").alias("code")).unionByName(
        marked.where("_bad").select("divisionId", "geometryHash", F.lit("LINE_INVALID").alias("code"))
    )


def area_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of an area index, countries and areas by ``kind``, each with the ``code`` of what is wrong with it, or null.

    Identities are unique; an area's country must be in the index, of the same version,
    and begin its id.
    """
    schema = "kind string, countryCode string, boundaryVersion string, areaId string, adminLevel string, nameZh string, nameLocal string, aliases array<string>"
    return index_codes(records(spark, path, schema))


def index_codes(rows: DataFrame) -> DataFrame:
    identity = F.when(F.col("kind") == "country", F.concat(F.lit("country:"), "countryCode")).when(F.col("kind") == "area", F.concat(F.lit("area:"), "areaId"))
    versions = rows.where("kind = 'country'").groupBy("countryCode").agg(F.min("boundaryVersion").alias("_version"))
    times = F.count("*").over(Window.partitionBy("_id"))
    code = (
        F.when(F.col("_id").isNull(), "KIND_INVALID").when(times > 1, "DUPLICATE_IDENTITY").when(F.col("kind") == "country", F.lit(None).cast("string"))
        .when(F.col("_version").isNull(), "COUNTRY_MISSING").when(~F.col("_version").eqNullSafe(F.col("boundaryVersion")), "VERSION_MISMATCH")
        .when(~F.coalesce(F.col("areaId").startswith(F.concat("countryCode", F.lit(":"))), F.lit(False)), "ID_COUNTRY_MISMATCH")
    )
    return rows.withColumn("_id", identity).join(versions, "countryCode", "left").withColumn("code", code).drop("_id", "_version")


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """Chinese names only; the filter runs in the scan."""
    df = _tsv(spark, path, ALTERNATE_NAMES, exact=False).where(F.col("language").isin("zh", "zh-CN"))
    return df.select(F.col("cityId").cast("bigint").alias("cityId"), "language", "name", (F.col("isPreferred") == "1").alias("is_preferred"))


def country_info(spark: SparkSession, path: str) -> DataFrame:
    """Code and continent of each country; lines that begin with # are comments. An unknown continent or a repeated code fails the query."""
    rows = _tsv(spark, path, COUNTRY_INFO, exact=False).where(~F.col("code").startswith("#"))
    known = F.coalesce(F.col("continent").isin(*CONTINENTS), F.lit(False))
    rows = rows.where(F.when(~known, F.raise_error(F.concat(F.lit("unknown continent of "), F.col("code")))).otherwise(True))
    return assert_unique(rows.select(F.col("code").alias("countryCode"), F.col("continent").alias("continentCode")), "countryCode")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object a line; strict fails on a bad line, else it stays in _corrupt."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def feature_rows(features: DataFrame) -> DataFrame:
    """GeoJSON features (type, properties map, geometry) as rows; names may be dotted keys."""
    p = lambda *keys: F.coalesce(*[F.col("properties")[k] for k in keys])
    return features.where("type = 'Feature'").select(
        p("divisionId", "division_id", "id").alias("divisionId"), p("sourceCountryCode", "country").alias("sourceCountryCode"),
        p("names.primary", "name").alias("name"), p("subtype").alias("subtype"),
        F.coalesce(p("isLand").try_cast("boolean"), F.lit(True)).alias("isLand"), "geometry",
    )


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Whole GeoJSON files as features with the country code of the file's name."""
    schema = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"\A([A-Z]{2})\.geojson\z", 1).alias("code"), F.explode("features").alias("f")
    ).select("code", "f.type", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def geometry_of(kind, coordinates):
    """Text of GeoJSON coordinates as polygons; a Polygon is one polygon."""
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    polygons = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)
    return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))).cast(GEOM)


def topology(df: DataFrame, column: str = "package") -> DataFrame:
    """Features of TopoJSON packages: arcs are prefix sums, negative references run backwards, rings share end points."""
    schema = (
        "transform struct<scale:array<double>,translate:array<double>>, arcs array<array<array<bigint>>>, "
        "objects map<string,struct<geometries:array<struct<id:string,type:string,arcs:array<array<array<int>>>>>>>"
    )
    doc = df.withColumn("_t", F.from_json(column, schema))
    arcs = F.transform(
        "_t.arcs",
        lambda a: F.transform(
            arc_points(F.transform(a, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))), 1.0),
            lambda p: F.struct((p["x"] * F.col("_t.transform.scale")[0] + F.col("_t.transform.translate")[0]).alias("x"), (p["y"] * F.col("_t.transform.scale")[1] + F.col("_t.transform.translate")[1]).alias("y")),
        ),
    )
    features = doc.withColumn("_arcs", arcs).select("_arcs", F.explode(F.flatten(F.transform(F.map_values("_t.objects"), lambda o: o["geometries"]))).alias("f"))

    def ring(refs):
        whole = F.transform(refs, lambda i: F.when(i >= 0, F.get("_arcs", i)).otherwise(F.reverse(F.get("_arcs", -i - 1))))
        return F.flatten(F.transform(whole, lambda a, n: F.when(n == 0, a).otherwise(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))))

    return features.select(F.col("f.id").alias("id"), F.transform(F.flatten("f.arcs"), ring).alias("rings"))


def manifest(df: DataFrame, column: str = "text") -> DataFrame:
    """A JSON object keyed by country as rows."""
    entry = "struct<schemaVersion:int,countryCode:string,boundaryVersion:string,featureCount:int,byteSize:bigint,checksum:string,updatedAt:string>"
    return df.select(F.explode(F.from_json(column, f"map<string,{entry}>")).alias("key", "e")).select("key", "e.*")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, one row each."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def files(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Name, size and, if asked, SHA-256 of files; without content no file is opened."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    # files in a folder of a partition bear its value
    cols = [F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.regexp_extract("path", r"=([^/=]+)/[^/]+\z", 1).alias("folder"), F.col("length").alias("byteSize")]
    return df.select(*cols, *([F.sha2("content", 256).alias("sha256")] if content else []))


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small relation of reviewed rows."""
    return spark.createDataFrame(rows, schema)


def backup(df: DataFrame, column: str = "document") -> dict[str, DataFrame]:
    """The tables of backup documents; another schemaVersion or text that is no document fails."""
    visit = "struct<cityId:bigint,createdAt:string,updatedAt:string,visitedOn:string,datePrecision:string,note:string>"
    boundary = f"struct<cityId:bigint,source:string,fetchedAt:string,sourceUrl:string,geometry:array<array<{RING}>>>"
    schema = f"schemaVersion int, exportedAt string, title string, visits array<{visit}>, boundaries array<{boundary}>"
    doc = df.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("d")).where(
        F.when(~F.coalesce(F.col("d.schemaVersion").isin(1, 2), F.lit(False)), F.raise_error(F.lit("unknown schemaVersion"))).otherwise(True)
    )
    rows = lambda name: doc.select(F.explode(f"d.{name}").alias("r")).select("r.*")
    return {"visits": rows("visits"), "boundaries": rows("boundaries")}
