"""Queries of scans, projections, filters, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators import changes_of_releases, gazetteer, nearby, relational, selector, store, visits
from cartomill.plans.base import AREA, BEFORE, CAND, CITY, LATEST, USABLE, areas, candidates, cities, query, release, release_sql
from cartomill.runtime import table

REL, PRE = release_sql(LATEST), release_sql(BEFORE)


@query("s1_scan", "SELECT areaId, countryCode, adminLevel FROM city_area WHERE adminLevel = 'county'")
def s1_scan(spark, d):
    return table(spark, d, "city_area").where(F.col("adminLevel") == "county").select("areaId", "countryCode", "adminLevel")


@query("s16_s17_parameters", f"SELECT c.id, c.countryCode, v.note FROM {CITY} c JOIN (VALUES ('XK', 'reviewed'), ('NA', 'kept')) v(countryCode, note) USING (countryCode) WHERE c.population >= 1000")
def s16_s17(spark, d):
    small = spark.createDataFrame([("XK", "reviewed"), ("NA", "kept")], "countryCode string, note string")
    return spark.sql(
        "SELECT c.id, c.countryCode, v.note FROM {c} c JOIN {v} v USING (countryCode) WHERE c.population >= :least",
        args={"least": 1000}, c=cities(spark, d), v=F.broadcast(small),
    )  # two literal rows


@query("s18_ids_in_text", "SELECT doc_id, unnest(regexp_extract_all(url, '[a-z0-9]{4,}')) AS token FROM documents")
def s18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("url", F.lit("([a-z0-9]{4,})"), 1)).alias("token"))


@query("proj1_rename", "SELECT areaId AS division_id, countryCode AS source_country, true AS is_land, centroid.x AS lon, centroid.y AS lat FROM city_area")
def proj1(spark, d):
    return table(spark, d, "city_area").select(
        F.col("areaId").alias("division_id"), F.col("countryCode").alias("source_country"), F.lit(True).alias("is_land"),
        F.col("centroid.x").alias("lon"), F.col("centroid.y").alias("lat"),
    )


@query("proj2_map_lookup", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def proj2(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("missing")).alias("missing"))


@query("proj7_fallback", f"SELECT id, coalesce(name, split_part(displayName, ',', 1)) AS name, coalesce(type, 'unknown') AS type FROM {CAND}")
def proj7(spark, d):
    return candidates(spark, d).select(
        "id", F.coalesce("name", F.split_part("displayName", F.lit(","), F.lit(1))).alias("name"), F.coalesce("type", F.lit("unknown")).alias("type")
    )


@query("proj8_display_name", f"SELECT areaId, CASE WHEN nameZh IS NULL THEN nameLocal WHEN nameLocal IS NULL OR nameZh = nameLocal THEN nameZh ELSE nameZh || ' · ' || nameLocal END AS label FROM {AREA}")
def proj8(spark, d):
    zh, local = F.col("nameZh"), F.col("nameLocal")
    return areas(spark, d).select(
        "areaId", F.when(zh.isNull(), local).when(local.isNull() | (zh == local), zh).otherwise(F.concat(zh, F.lit(" · "), local)).alias("label")
    )


_CODES = ["packageId[1:2]", "CASE WHEN nameZh IS NULL THEN '-99' ELSE countryCode END", "adminLevel", "countryCode"]


@query("proj10_first_valid_code", "SELECT areaId, coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({c}, '[A-Z]{{2}}') THEN {c} END" for c in _CODES) + f") AS code FROM {AREA}")
def proj10(spark, d):
    """First valid of four code fields; -99 stands for none."""
    fields = [F.substring("packageId", 1, 2), F.when(F.col("nameZh").isNull(), "-99").otherwise(F.col("countryCode")), F.col("adminLevel"), F.col("countryCode")]
    return areas(spark, d).select("areaId", F.coalesce(*[F.when(text.is_form(c, "iso2"), c) for c in fields]).alias("code"))


@query("f2_membership", "SELECT areaId FROM city_area WHERE list_contains(['XK', 'XA'], countryCode)")
def f2(spark, d):
    return table(spark, d, "city_area").where(F.col("countryCode").isin("XK", "XA")).select("areaId")


@query("f3_f4_code_split", "SELECT coalesce(regexp_full_match(countryCode, '[A-Z]{2}'), false) AS resolved, count(*) AS n FROM boundary_candidate GROUP BY 1")
def f3_f4(spark, d):
    good = F.coalesce(F.col("countryCode").rlike(r"\A[A-Z]{2}\z"), F.lit(False))
    return table(spark, d, "boundary_candidate").groupBy(good.alias("resolved")).agg(F.count("*").alias("n"))


_SELECTED = "(upper(countryCode) IN ('XK', 'XA', 'XB') AND geometry IS NOT NULL AND (source IN ('overture', 'geo-registry') AND adminLevel IN ('municipality', 'county', '7') AND adminLevel IN ('county', '7') OR sourceId[-1] = '1') AND NOT sourceId[-1] = '2')"


def _selector_rows(spark, d):
    """Areas with the rule's local type, and the ids that are allowed and denied by their last letter."""
    last = F.right("sourceId", F.lit(1))
    return areas(spark, d).select("*", F.col("geometry").isNotNull().alias("isLand"), F.when(last == "1", "allowed").when(last == "2", "denied").otherwise("other").alias("listed"))


_RULES = selector.Selector(
    owners=("XK", "xa", "XB"), subtypes=("overture", "geo-registry"), levels=("municipality", "county", "7"), local_types=(("county", "7"),), allow=("allowed",), deny=("denied",),
    columns={"id": "listed", "owner": "countryCode", "subtype": "source", "level": "adminLevel", "local": "adminLevel", "land": "isLand"},
)


@query("f5_selector", f"SELECT areaId, countryCode, 'ZZ' AS sovereignCode FROM {AREA} WHERE coalesce({_SELECTED}, false)")
def f5(spark, d):
    """Owners, subtypes, levels, local types, allowed and denied ids."""
    return _selector_rows(spark, d).where(selector.predicate(_RULES)).select("areaId", "countryCode", F.lit("ZZ").alias("sovereignCode"))


@query("a22_selection_counts", f"SELECT count(*) AS source, count(*) FILTER (s) AS selected, count(*) FILTER (NOT s) AS excluded, count(*) FILTER (s AND sourceId[-1] = '1') AS allowlisted, count(*) FILTER (sourceId[-1] = '2') AS denylisted FROM (SELECT *, coalesce({_SELECTED}, false) AS s FROM {AREA})")
def a22(spark, d):
    return _selector_rows(spark, d).agg(*selector.counts(_RULES))


@query("f7_named", "SELECT count(*) AS n, count(*) FILTER (zhName IS NOT NULL AND length(trim(zhName)) > 0) AS named FROM city_summary")
def f7(spark, d):
    return table(spark, d, "city_summary").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("zhName")) > 0).alias("named"))


def _plain(e):
    """SQL: full-width letters as plain ones, accents gone, as the normaliser does for the letters of these tables."""
    wide = f"array_to_string(list_transform(string_split({e}, ''), lambda ch: CASE WHEN unicode(ch) BETWEEN 65281 AND 65374 THEN chr(unicode(ch) - 65248) WHEN unicode(ch) = 12288 THEN ' ' ELSE ch END), '')"
    return f"lower(trim(strip_accents({wide})))"


_KEPT = "SELECT id, name, asciiName, k, zhName, z, list_filter(k, lambda x: x <> name AND x <> asciiName AND NOT list_contains(z, x)) AS own FROM (SELECT *, list_filter(k, lambda x: length(x) % 4 = 0) AS z FROM (SELECT id, name, asciiName, zhName, list_filter(u, lambda x, i: list_position(u, x) = i) AS k FROM (SELECT *, list_filter(list_transform(coalesce(aliases, []), lambda a: regexp_replace(a, '\\A[\\s\\p{Z}\\x{feff}]+|[\\s\\p{Z}\\x{feff}]+\\z', '', 'g')), lambda a: a <> '') AS u FROM " + CITY + ")))"


def _aliases(spark, d):
    """Cities whose aliases of a length divisible by four stand for Chinese ones too."""
    names = gazetteer.unique_strings(F.col("aliases"))
    return cities(spark, d).withColumn("zh", F.filter(names, lambda a: F.length(a) % 4 == 0))


@query("f10_kept_aliases", f"SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS aliases FROM (SELECT id, list_concat(own[1:3], list_filter(z, lambda x: x IS DISTINCT FROM zhName AND x <> name AND x <> asciiName)) AS a FROM ({_KEPT}))")
def f10(spark, d):
    kept = gazetteer.kept_aliases(F.col("aliases"), F.col("name"), F.col("asciiName"), F.col("zhName"), F.col("zh"))
    return _aliases(spark, d).select("id", F.array_join(kept, "|").alias("aliases"))


@query("a23_truncated_aliases", f"SELECT count(*) FILTER (len(own) > 3) AS truncated FROM ({_KEPT})")
def a23(spark, d):
    own = gazetteer.source_aliases(F.col("aliases"), F.col("name"), F.col("asciiName"), F.col("zh"))
    return _aliases(spark, d).agg(F.count_if(F.size(own) > gazetteer.ALIASES).alias("truncated"))


@query("f12_j4_city_build", f"SELECT c.id, c.name, i.continentCode, c.zhName, nullif(c.admin1, '') AS admin1, c.population FROM {CITY} c JOIN (SELECT DISTINCT countryCode, continentCode FROM country_info) i USING (countryCode) WHERE {USABLE} AND name <> '' AND asciiName <> ''")
def f12(spark, d):
    """Cities built from rows, countries and Chinese names; what the build would refuse is left to f12_refused."""
    c = cities(spark, d)
    right = nearby.usable(F.col("lat"), F.col("lon")) & (F.col("name") != "") & (F.col("asciiName") != "")
    i = table(spark, d, "country_info")
    known = c.where(right).join(i.select("countryCode").distinct(), "countryCode", "left_semi")
    zh = c.where("zhName IS NOT NULL").select(F.col("id").alias("cityId"), F.col("zhName").alias("preferred"), F.array().cast("array<string>").alias("aliases"))
    return gazetteer.build_cities(known, i, zh).select("id", "name", "continentCode", "zhName", "admin1", "population")


@query("f12_refused", f"SELECT id, CASE WHEN NOT coalesce({USABLE} AND name <> '' AND asciiName <> '' AND countryCode <> '', false) THEN 'INVALID_REQUIRED_VALUE' WHEN countryCode NOT IN (SELECT countryCode FROM country_info) THEN 'UNKNOWN_COUNTRY' END AS code FROM {CITY} WHERE code IS NOT NULL")
def f12_refused(spark, d):
    return gazetteer.refused_cities(cities(spark, d), table(spark, d, "country_info")).select("id", "code")


_SAME = ["schemaVersion", "countryCode", "boundaryVersion", "administrativeScheme", "featureCount", "byteSize", "checksum", "source", "attribution"]


@query("f14_cache_decision", f"SELECT n.packageId, CASE WHEN o.packageId IS NULL THEN CASE WHEN n.featureCount IS NULL THEN 'unavailable' ELSE 'fresh' END WHEN {' AND '.join(f'n.{c} IS NOT DISTINCT FROM o.{c}' for c in _SAME)} THEN 'cached' WHEN n.featureCount IS NULL THEN 'stale-cache' ELSE 'fresh' END AS status FROM (SELECT * FROM country_manifest WHERE boundaryRelease = '{LATEST}' QUALIFY row_number() OVER (PARTITION BY packageId ORDER BY loadedAt DESC) = 1) n LEFT JOIN (SELECT * FROM country_manifest WHERE boundaryRelease = '{BEFORE}' QUALIFY row_number() OVER (PARTITION BY packageId ORDER BY loadedAt DESC) = 1) o USING (packageId)")
def f14(spark, d):
    """A package is cached where all its entry equals the kept one; one that can not be loaded (no count here) is served stale, if it is kept."""
    m = table(spark, d, "country_manifest")
    pick = lambda r: m.where(F.col("boundaryRelease") == r).groupBy("packageId").agg(F.max_by(F.struct(*_SAME), "loadedAt").alias("e")).select("packageId", "e.*")
    return relational.cache_status(pick(LATEST), pick(BEFORE), "packageId", _SAME, F.col("featureCount").isNotNull())


@query("f15_safe_urls", "SELECT doc_id FROM documents WHERE regexp_matches(url, '^https://[^/@?#]+') AND NOT regexp_matches(url, '^https://[^/]*@') AND NOT regexp_matches(lower(url), '[?&](token|key|secret|password)=')")
def f15(spark, d):
    url = F.col("url")
    return table(spark, d, "documents").where(
        url.rlike(r"\Ahttps://[^/@?#]+") & ~url.rlike(r"\Ahttps://[^/]*@") & ~F.lower(url).rlike("[?&](token|key|secret|password)=")
    ).select("doc_id")


@query("j1_area_snapshot", f"SELECT a.areaId, a.countryCode, s.geometryHash FROM {AREA} a JOIN {REL} s USING (areaId) WHERE list_contains(['XK', 'XA', 'XB'], a.countryCode)")
def j1(spark, d):
    a = areas(spark, d).where(F.col("countryCode").isin("XK", "XA", "XB")).select("areaId", "countryCode")
    return a.join(release(spark, d, LATEST).select("areaId", "geometryHash"), "areaId")


@query("j2_j3_u1_overrides", f"SELECT areaId, countryCode, 'owned' AS kind FROM {AREA} WHERE countryCode = 'XK' UNION ALL SELECT a.areaId, a.countryCode, 'reviewed' FROM {AREA} a JOIN (SELECT DISTINCT areaId, packageId FROM {PRE} WHERE adminLevel = '6') o USING (areaId, packageId) JOIN {REL} r USING (areaId) WHERE a.countryCode <> 'XK'")
def j2_j3(spark, d):
    a = areas(spark, d)
    own = a.where("countryCode = 'XK'").select("areaId", "countryCode", F.lit("owned").alias("kind"))
    o = release(spark, d, BEFORE).where("adminLevel = '6'").select("areaId", "packageId").distinct()
    kept = a.where("countryCode <> 'XK'").join(o, ["areaId", "packageId"]).join(release(spark, d, LATEST).select("areaId"), "areaId")
    return own.unionByName(kept.select("areaId", "countryCode", F.lit("reviewed").alias("kind")))


@query("j4_j5_dimensions", f"SELECT c.id, i.countryName, coalesce(c.continentCode, i.continentCode) AS continent FROM {CITY} c LEFT JOIN (SELECT DISTINCT * FROM country_info) i USING (countryCode)")
def j4_j5(spark, d):
    info = table(spark, d, "country_info").distinct().withColumnRenamed("continentCode", "_c")
    return cities(spark, d).join(info, "countryCode", "left").select("id", "countryName", F.coalesce("continentCode", "_c").alias("continent"))


@query("j6_presence", f"SELECT p.packageId, m.packageId IS NOT NULL AS in_manifest FROM (SELECT DISTINCT packageId FROM city_area WHERE packageId IS NOT NULL) p LEFT JOIN (SELECT DISTINCT packageId FROM country_manifest WHERE boundaryRelease = '{LATEST}') m ON p.packageId = m.packageId")
def j6(spark, d):
    p = table(spark, d, "city_area").where("packageId IS NOT NULL").select("packageId").distinct()
    m = table(spark, d, "country_manifest").where(F.col("boundaryRelease") == LATEST).select("packageId").distinct().withColumn("_m", F.lit(True))
    return p.join(m, "packageId", "left").select("packageId", F.col("_m").isNotNull().alias("in_manifest"))


def _package(spark, d, r):
    return table(spark, d, "country_manifest").where(F.col("boundaryRelease") == r).groupBy("packageId").agg(F.max_by("featureCount", "loadedAt").alias("n"))


def _package_sql(r):
    return f"(SELECT packageId, featureCount n FROM country_manifest WHERE boundaryRelease = '{r}' QUALIFY row_number() OVER (PARTITION BY packageId ORDER BY loadedAt DESC) = 1)"


@query("j7_a24_release_delta", f"SELECT coalesce(a.packageId, b.packageId) AS packageId, CASE WHEN a.n IS NULL OR b.n IS NULL THEN NULL WHEN a.n = 0 THEN CASE WHEN b.n = 0 THEN 0.0 ELSE 100.0 END ELSE round(abs(b.n - a.n) / a.n::double * 100, 6) END AS delta FROM {_package_sql(BEFORE)} a FULL JOIN {_package_sql(LATEST)} b ON a.packageId = b.packageId")
def j7(spark, d):
    a, b = _package(spark, d, BEFORE).withColumnRenamed("n", "a"), _package(spark, d, LATEST).withColumnRenamed("n", "b")
    delta = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(None))
        .when(F.col("a") == 0, F.when(F.col("b") == 0, 0.0).otherwise(100.0))
        .otherwise(F.round(F.abs(F.col("b") - F.col("a")) / F.col("a") * 100, 6))
    )
    return a.join(b, "packageId", "full_outer").select("packageId", delta.alias("delta"))


@query("j8_added_deleted", f"SELECT areaId, 'deleted' AS code FROM {PRE} WHERE areaId NOT IN (SELECT areaId FROM {REL}) UNION ALL SELECT areaId, 'added' FROM {REL} WHERE areaId NOT IN (SELECT areaId FROM {PRE})")
def j8(spark, d):
    return relational.set_difference(release(spark, d, BEFORE), release(spark, d, LATEST), "areaId", "deleted", "added")


@query("j9_changed_geometry", f"SELECT n.areaId FROM {REL} n JOIN {PRE} o USING (areaId) WHERE n.geometryHash <> o.geometryHash")
def j9(spark, d):
    o = release(spark, d, BEFORE).select("areaId", F.col("geometryHash").alias("_h"))
    return release(spark, d, LATEST).join(o, "areaId").where("geometryHash <> _h").select("areaId")


@query("j10_exact_set", f"SELECT areaId, 'missing' AS code FROM {PRE} WHERE areaId NOT IN (SELECT areaId FROM city_area) UNION ALL SELECT DISTINCT areaId, 'extra' FROM city_area WHERE areaId NOT IN (SELECT areaId FROM {PRE})")
def j10(spark, d):
    """Areas of the release before against those of the last."""
    return relational.set_difference(release(spark, d, BEFORE), table(spark, d, "city_area"), "areaId")


_FIELDS = ["countryCode", "packageId", "nameZh", "nameLocal", "adminLevel"]


@query("j11_field_mismatch", " UNION ALL ".join(f"SELECT areaId, '{c}' AS \"column\" FROM {AREA} a JOIN {REL} s USING (areaId) WHERE a.{c} IS DISTINCT FROM s.{c}" for c in _FIELDS))
def j11(spark, d):
    return relational.mismatches(areas(spark, d), release(spark, d, LATEST), "areaId", _FIELDS)


RAYCAST = f"""
WITH RECURSIVE c AS (SELECT id, lat, lon FROM {CITY} WHERE {USABLE}),
g AS (SELECT areaId, pi, ri, p FROM (SELECT areaId, pi, unnest(range(1, len(poly) + 1)) ri, unnest(poly) p FROM (SELECT areaId, unnest(range(1, len(geometry) + 1)) pi, unnest(geometry) poly FROM {AREA} WHERE geometry IS NOT NULL))),
v AS (SELECT areaId, pi, ri, i, p[i].x x, p[i].y y FROM (SELECT *, unnest(range(1, len(p) + 1)) i FROM g)),
t AS (SELECT *, coalesce(sum(CASE WHEN x - px > 180 THEN -360 WHEN x - px < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY areaId, pi, ri ORDER BY i), 0) off FROM (SELECT *, lag(x) OVER (PARTITION BY areaId, pi, ri ORDER BY i) px FROM v)),
u0 AS (SELECT areaId, pi, ri, i, x + off x, y FROM t),
m AS (SELECT areaId, pi, ri, (min(x) + max(x)) / 2 mid FROM u0 GROUP BY ALL),
u AS (SELECT u0.areaId, u0.pi, u0.ri, i, x - 360 * round((m.mid - o.mid) / 360) x, y FROM u0 JOIN m USING (areaId, pi, ri) JOIN m o ON o.areaId = u0.areaId AND o.pi = u0.pi AND o.ri = 1),
b AS (SELECT areaId, pi, min(x) - 1e-9 x0, max(x) + 1e-9 x1, min(y) - 1e-9 y0, max(y) + 1e-9 y1 FROM u GROUP BY ALL),
k AS (SELECT c.id, b.areaId, b.pi, c.lon + s.s px, c.lat py FROM c, b, (VALUES (-360), (0), (360)) s(s) WHERE c.lat BETWEEN y0 AND y1 AND c.lon + s.s BETWEEN x0 AND x1),
e AS (SELECT areaId, pi, ri, x, y, lead(x) OVER w x2, lead(y) OVER w y2 FROM u WINDOW w AS (PARTITION BY areaId, pi, ri ORDER BY i)),
r AS (SELECT k.id, k.areaId, k.pi, k.px, e.ri,
        sum(CASE WHEN (e.y <= py) <> (e.y2 <= py) AND px < e.x + (py - e.y) * (e.x2 - e.x) / (e.y2 - e.y) THEN 1 ELSE 0 END) % 2 = 1 inner_,
        bool_or(abs((e.x2 - e.x) * (py - e.y) - (e.y2 - e.y) * (px - e.x)) <= 1e-9 * sqrt(pow(e.x2 - e.x, 2) + pow(e.y2 - e.y, 2)) AND px BETWEEN least(e.x, e.x2) - 1e-9 AND greatest(e.x, e.x2) + 1e-9 AND py BETWEEN least(e.y, e.y2) - 1e-9 AND greatest(e.y, e.y2) + 1e-9) edge
      FROM k JOIN e USING (areaId, pi) WHERE e.x2 IS NOT NULL GROUP BY ALL),
z AS (SELECT id, areaId FROM r GROUP BY id, areaId, pi, px HAVING bool_or(ri = 1 AND (inner_ OR edge)) AND NOT bool_or(ri > 1 AND inner_ AND NOT edge))
SELECT DISTINCT id AS city_id, areaId FROM z
"""


@query("j12_contains", RAYCAST)
def j12(spark, d):
    c = cities(spark, d).select(F.col("id").cast("string").alias("key"), "lat", "lon")
    a = areas(spark, d).select(F.col("areaId").alias("key"), "geometry")
    return nearby.containing(c, a).select(F.col("key_a").cast("bigint").alias("city_id"), F.col("key_b").alias("areaId"))


@query("j23_map_status", f"WITH h AS ({RAYCAST}), n AS (SELECT city_id, count(*) n, string_agg(areaId, '|' ORDER BY areaId) a FROM h GROUP BY 1) SELECT c.id AS city_id, CASE WHEN c.countryCode NOT IN (SELECT countryCode FROM city_area WHERE countryCode < 'XH') THEN 'country-unavailable' WHEN n.n = 1 THEN 'resolved' WHEN n.n > 1 THEN 'ambiguous' ELSE 'outside' END AS status, CASE WHEN c.countryCode IN (SELECT countryCode FROM city_area WHERE countryCode < 'XH') THEN n.a END AS areas FROM {CITY} c LEFT JOIN n ON n.city_id = c.id WHERE c.countryCode IS NOT NULL")
def j23(spark, d):
    c = cities(spark, d).where("countryCode IS NOT NULL").select(F.col("id").cast("string").alias("key"), "countryCode", "lat", "lon")
    a = areas(spark, d)
    pairs = nearby.containing(c.select("key", "lat", "lon"), a.select(F.col("areaId").alias("key"), "geometry"))
    return visits.mapped(c.select("key", "countryCode"), pairs, a.where("countryCode < 'XH'")).select(
        F.col("key").cast("bigint").alias("city_id"), "status", F.array_join("areas", "|").alias("areas")
    )


KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


@query("j14_nearest", f"SELECT id, km, row_number() OVER (ORDER BY km, coalesce(population, 0) DESC, id) AS position FROM (SELECT id, population, round({KM.format(lat1='lat', lon1='lon', lat2='40.6', lon2='-31.7')}, 6) km FROM {CITY} WHERE {USABLE}) ORDER BY position LIMIT 12")
def j14(spark, d):
    near = gazetteer.nearest(cities(spark, d), -31.7, 40.6, 12)
    w = Window.orderBy("km", F.coalesce("population", F.lit(0)).desc(), "id")  # twelve rows
    return near.select("id", "km", F.row_number().over(w).cast("bigint").alias("position"))


@query("j15_boundary_or_point", f"SELECT c.id, CASE WHEN b.countryCode IS NOT NULL THEN 'path' ELSE 'point' END AS kind FROM {CITY} c LEFT JOIN (SELECT DISTINCT countryCode, nameLocal FROM city_area WHERE geometry IS NOT NULL) b ON b.countryCode = c.countryCode AND b.nameLocal = c.name")
def j15(spark, d):
    b = table(spark, d, "city_area").where("geometry IS NOT NULL").select("countryCode", F.col("nameLocal").alias("name")).distinct().withColumn("_b", F.lit(True))
    return cities(spark, d).join(b, ["countryCode", "name"], "left").select("id", F.when(F.col("_b").isNotNull(), "path").otherwise("point").alias("kind"))


@query("j16_rank_candidates", f"""
WITH n AS (SELECT id, upper(countryCode) countryCode, term, max(points) points FROM (
  SELECT id, countryCode, {_plain('zhName')} term, 50 points FROM {CITY} UNION ALL SELECT id, countryCode, {_plain('name')}, 40 FROM {CITY}
  UNION ALL SELECT id, countryCode, {_plain('asciiName')}, 30 FROM {CITY} UNION ALL SELECT id, countryCode, {_plain('a')}, 20 FROM (SELECT id, countryCode, unnest(aliases) a FROM {CITY})) WHERE term <> '' GROUP BY ALL),
p AS (SELECT id candidate_id, upper(countryCode) countryCode, type, importance, {_plain('name')} term, 1000 base FROM {CAND}
  UNION ALL SELECT id, upper(countryCode), type, importance, trim(unnest(string_split({_plain("coalesce(displayName, '')")}, ','))), 500 FROM {CAND}),
s AS (SELECT n.id city_id, candidate_id, round(max(base + points + CASE WHEN type IN ('city', 'town', 'administrative', 'municipality') THEN 10 ELSE 0 END + greatest(0.0, least(1.0, coalesce(importance, 0.0)))), 6) score
  FROM p JOIN n USING (countryCode, term) WHERE term <> '' GROUP BY ALL)
SELECT city_id, candidate_id, score, row_number() OVER (PARTITION BY city_id ORDER BY score DESC, candidate_id) AS position FROM s
""")
def j16(spark, d):
    return gazetteer.rank_candidates(cities(spark, d), candidates(spark, d)).withColumn("position", F.col("position").cast("bigint"))


@query("j17_own_country", f"SELECT a.areaId, i.countryCode IS NOT NULL AS known, starts_with(a.areaId, a.countryCode || ':') AS own_prefix, coalesce(m.featureCount IS NOT NULL, false) AS counted FROM {AREA} a LEFT JOIN (SELECT DISTINCT countryCode FROM country_info) i USING (countryCode) LEFT JOIN (SELECT packageId, max_by(featureCount, loadedAt) featureCount FROM country_manifest WHERE boundaryRelease = '{LATEST}' GROUP BY 1) m ON m.packageId = a.packageId")
def j17(spark, d):
    i = table(spark, d, "country_info").select("countryCode").distinct().withColumn("_i", F.lit(True))
    m = table(spark, d, "country_manifest").where(F.col("boundaryRelease") == LATEST).groupBy("packageId").agg(F.max_by("featureCount", "loadedAt").alias("_n"))
    return areas(spark, d).join(i, "countryCode", "left").join(m, "packageId", "left").select(
        "areaId", F.col("_i").isNotNull().alias("known"), F.col("areaId").startswith(F.concat("countryCode", F.lit(":"))).alias("own_prefix"), F.col("_n").isNotNull().alias("counted")
    )


@query("j19_owner_map", "WITH r AS (SELECT countryCode AS owner, unnest(list_distinct([countryCode, countryCode[1] || 'Z'])) AS code FROM (SELECT DISTINCT countryCode FROM country_info)) SELECT code, CASE WHEN count(*) = 1 THEN min(owner) END AS owner, count(*) > 1 AS contested FROM r GROUP BY code")
def j19(spark, d):
    """Source codes of each country, its own and one that all with its first letter name: the owner of each, or that it is contested."""
    r = table(spark, d, "country_info").select(F.col("countryCode").alias("owner"), F.array_distinct(F.array("countryCode", F.concat(F.substring("countryCode", 1, 1), F.lit("Z")))).alias("codes")).distinct()
    return relational.owner_of(r, "owner", "codes")


@query("j20_j21_unknown_references", f"SELECT DISTINCT s.areaId, 'UNKNOWN_CURRENT' AS code FROM area_snapshot s WHERE NOT EXISTS (SELECT 1 FROM city_area a WHERE a.areaId = s.areaId) UNION ALL SELECT DISTINCT a.areaId, 'UNKNOWN_SNAPSHOT' FROM city_area a WHERE NOT EXISTS (SELECT 1 FROM {PRE} s WHERE a.areaId = s.areaId)")
def j20(spark, d):
    """References of the snapshots that no current area has, and current areas that the release before lacks."""
    now, old = table(spark, d, "city_area"), release(spark, d, BEFORE)
    all_old = table(spark, d, "area_snapshot")
    return relational.unknown_references(all_old, now, "areaId", "UNKNOWN_CURRENT").unionByName(relational.unknown_references(now, old, "areaId", "UNKNOWN_SNAPSHOT"))


_MIG = f"(SELECT o.areaId AS old_id, n.areaId AS new_id FROM {PRE} o JOIN {REL} n ON o.nameLocal = n.nameLocal AND o.countryCode = n.countryCode AND o.areaId <> n.areaId)"


def _migrations(spark, d):
    """(old_id, new_id) of areas of two releases with one name and country and different ids."""
    o, n = (release(spark, d, r).select(F.col("areaId").alias(k), "nameLocal", "countryCode") for r, k in ((BEFORE, "old_id"), (LATEST, "new_id")))
    return o.join(n, ["nameLocal", "countryCode"]).where("old_id <> new_id").select("old_id", "new_id")


@query("a18_v8_migrations", f"WITH m AS {_MIG}, k AS (SELECT old_id, new_id, count(*) OVER (PARTITION BY old_id) a, count(*) OVER (PARTITION BY new_id) b FROM m) SELECT CASE WHEN a = 1 AND b = 1 THEN '1-1' WHEN b = 1 THEN '1-n' WHEN a = 1 THEN 'n-1' ELSE 'n-n' END AS type, count(*) AS n FROM k GROUP BY 1")
def a18(spark, d):
    return changes_of_releases.migration_types(_migrations(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("m2_v7_release_report", f"""
WITH o AS (SELECT *, coalesce(countryCode, '?') c FROM {PRE}), n AS (SELECT *, coalesce(countryCode, '?') c FROM {REL}),
co AS (SELECT c, count(*) a FROM o GROUP BY 1), cn AS (SELECT c, count(*) b FROM n GROUP BY 1),
m AS (SELECT coalesce(co.c, cn.c) c, coalesce(a, 0) a, coalesce(b, 0) b FROM co FULL JOIN cn USING (c)),
del AS (SELECT c, count(*) k FROM o WHERE areaId NOT IN (SELECT areaId FROM n) GROUP BY 1), ad AS (SELECT c, count(*) k FROM n WHERE areaId NOT IN (SELECT areaId FROM o) GROUP BY 1),
ch AS (SELECT n.c, count(*) k FROM n JOIN o USING (areaId) WHERE n.geometryHash IS DISTINCT FROM o.geometryHash GROUP BY 1)
SELECT m.c AS countryCode, coalesce(ad.k, 0) AS added, coalesce(del.k, 0) AS deleted, coalesce(ch.k, 0) AS changed, round(CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0 ELSE 100 END ELSE abs(b - a) * 100.0 / a END, 6)::DOUBLE AS delta,
  CASE WHEN coalesce(del.k, 0) > 0 AND b > 0 AND (abs(b - a) * 100.0 / a) > 5 THEN 'blocked' WHEN coalesce(del.k, 0) + coalesce(ad.k, 0) + coalesce(ch.k, 0) > 0 THEN 'manual-review-required' ELSE 'no-review-required' END AS state
FROM m LEFT JOIN del USING (c) LEFT JOIN ad USING (c) LEFT JOIN ch USING (c) WHERE a > 0
""")
def m2(spark, d):
    """Counts of what changed in each country of the release before; one that lost areas and changed by over 5 % is blocked."""
    old, new = (release(spark, d, r).withColumn("countryCode", F.coalesce("countryCode", F.lit("?"))) for r in (BEFORE, LATEST))
    r = changes_of_releases.report(old, new, "areaId", "countryCode", "geometryHash", most=5.0)
    return r.where("before > 0").select("countryCode", "added", "deleted", "changed", "delta", "state")


@query("j22_bindings", f"""
WITH r AS (SELECT DISTINCT countryCode FROM country_info), m AS (SELECT countryCode, sum(featureCount) n FROM (SELECT * FROM country_manifest WHERE boundaryRelease = '{LATEST}' QUALIFY row_number() OVER (PARTITION BY packageId ORDER BY loadedAt DESC) = 1) GROUP BY 1),
p AS (SELECT countryCode, count(DISTINCT areaId) n FROM city_area GROUP BY 1), s AS (SELECT countryCode, count(*) n FROM {REL} GROUP BY 1),
k AS (SELECT countryCode FROM r UNION SELECT countryCode FROM m UNION SELECT countryCode FROM p UNION SELECT countryCode FROM s)
SELECT k.countryCode, concat_ws('|', CASE WHEN r.countryCode IS NULL THEN 'registry:MISSING' END, CASE WHEN m.countryCode IS NULL THEN 'manifest:MISSING' END, CASE WHEN p.countryCode IS NULL THEN 'package:MISSING' END, CASE WHEN s.countryCode IS NULL THEN 'snapshot:MISSING' END,
  CASE WHEN m.n <> p.n THEN 'manifest-package:DIFFERENT' END, CASE WHEN p.n <> s.n THEN 'package-snapshot:DIFFERENT' END) AS codes
FROM k LEFT JOIN r USING (countryCode) LEFT JOIN m USING (countryCode) LEFT JOIN p USING (countryCode) LEFT JOIN s USING (countryCode)
""")
def j22(spark, d):
    """Registry, manifest, packages and snapshot of each country: present, and of one count."""
    m = table(spark, d, "country_manifest").where(F.col("boundaryRelease") == LATEST).groupBy("packageId").agg(F.max_by(F.struct("countryCode", "featureCount"), "loadedAt").alias("e"))
    sides = {
        "registry": table(spark, d, "country_info").select("countryCode").distinct().withColumn("n", F.lit(None).cast("bigint")),
        "manifest": m.groupBy(F.col("e.countryCode").alias("countryCode")).agg(F.sum("e.featureCount").alias("n")),
        "package": table(spark, d, "city_area").groupBy("countryCode").agg(F.countDistinct("areaId").alias("n")),
        "snapshot": release(spark, d, LATEST).groupBy("countryCode").agg(F.count("*").alias("n")),
    }
    return changes_of_releases.bindings(sides, "countryCode", "n", [("manifest", "package"), ("package", "snapshot")]).select("countryCode", F.array_join("codes", "|").alias("codes"))


@query("j25_v9_world_owners", "WITH w AS (SELECT DISTINCT countryCode AS world_id FROM city_area UNION SELECT DISTINCT countryCode FROM city_summary WHERE countryCode IS NOT NULL), r AS (SELECT DISTINCT countryCode FROM country_info) SELECT world_id, r.countryCode AS owner, CASE WHEN world_id = 'XK' THEN 'EXCLUDED' WHEN r.countryCode IS NULL THEN 'UNOWNED' END AS code FROM w LEFT JOIN r ON r.countryCode = world_id AND world_id <> 'XK'")
def j25(spark, d):
    """Every code that has a shape or a city, its owner in the registry, those excluded by name apart."""
    world = table(spark, d, "city_area").select(F.col("countryCode").alias("world_id")).union(table(spark, d, "city_summary").where("countryCode IS NOT NULL").select("countryCode")).distinct()
    return relational.owned(world, "world_id", table(spark, d, "country_info").select("countryCode").distinct(), "countryCode", ["XK"])


@query("a1_counts", "SELECT countryCode, count(*) AS n FROM city_area GROUP BY countryCode")
def a1(spark, d):
    return table(spark, d, "city_area").groupBy("countryCode").agg(F.count("*").alias("n"))


@query("a2_total", "SELECT count(*) AS n FROM city_area")
def a2(spark, d):
    return table(spark, d, "city_area").agg(F.count("*").alias("n"))


@query("a3_profile", "SELECT countryCode, source, adminLevel, CASE WHEN nameZh IS NULL THEN NULL ELSE length(nameZh) END AS zh_length, count(*) AS n, count(*) FILTER (nameLocal IS NOT NULL AND length(trim(nameLocal)) > 0) AS named FROM city_area GROUP BY ALL")
def a3(spark, d):
    return table(spark, d, "city_area").groupBy("countryCode", "source", "adminLevel", F.length("nameZh").cast("bigint").alias("zh_length")).agg(
        F.count("*").alias("n"), F.count_if(F.length(F.trim("nameLocal")) > 0).alias("named")
    )


@query("a4_a5_coverage", "SELECT countryCode, count(*) AS total, count(*) - count(nameZh) AS missing, round(count(nameZh) / count(*), 6) AS ratio FROM city_area GROUP BY countryCode UNION ALL SELECT NULL, count(*), count(*) - count(nameZh), round(count(nameZh) / count(*), 6) FROM city_area")
def a4_a5(spark, d):
    return table(spark, d, "city_area").rollup("countryCode").agg(
        F.count("*").alias("total"), (F.count("*") - F.count("nameZh")).alias("missing"), F.round(F.count("nameZh") / F.count("*"), 6).alias("ratio")
    )


@query("a6_percentiles", f"SELECT countryCode, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS most FROM (SELECT countryCode, len(flatten(flatten(geometry))) v FROM {AREA} WHERE geometry IS NOT NULL) GROUP BY countryCode")
def a6(spark, d):
    from cartomill.functions import geo

    v = areas(spark, d).where("geometry IS NOT NULL").select("countryCode", geo.vertices(F.col("geometry")).alias("v"))
    return v.groupBy("countryCode").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").cast("bigint").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").cast("bigint").alias("p95"), F.max("v").cast("bigint").alias("most"),
    )


@query("a7_sizes", "SELECT boundaryRelease, coalesce(sum(byteSize), 0)::BIGINT AS total, min(byteSize) AS least, max(byteSize) AS most FROM country_manifest GROUP BY boundaryRelease")
def a7(spark, d):
    return table(spark, d, "country_manifest").groupBy("boundaryRelease").agg(
        F.coalesce(F.sum("byteSize"), F.lit(0)).cast("bigint").alias("total"), F.min("byteSize").alias("least"), F.max("byteSize").alias("most")
    )


def _visits(spark, d):
    return table(spark, d, "orders").join(cities(spark, d).select("id", "countryCode", "continentCode"), (F.col("o_orderkey") % 50000 + 10000000) == F.col("id"))


@query("a8_stats", f"SELECT (SELECT count(*) FROM {CITY}) AS city_count, (SELECT count(DISTINCT countryCode) FROM {CITY}) AS country_count, continentCode AS continent, count(*)::INT AS n FROM {CITY} WHERE continentCode IS NOT NULL GROUP BY continentCode")
def a8(spark, d):
    v = table(spark, d, "city_summary").select(F.col("id").alias("cityId"), "countryCode", "continentCode", F.xxhash64("id").alias("ordinal"))
    return visits.stats(v).select("city_count", "country_count", F.explode("continent_counts").alias("continent", "n"))


@query("a9_union_totals", f"SELECT (SELECT count(*) FROM {CITY} WHERE id % 3 = 0) AS cities, (SELECT count(*) FROM {AREA} WHERE length(areaId) % 2 = 0) AS areas, (SELECT count(DISTINCT c) FROM (SELECT countryCode c FROM {CITY} WHERE id % 3 = 0 UNION ALL SELECT countryCode FROM {AREA} WHERE length(areaId) % 2 = 0)) AS countries")
def a9(spark, d):
    """City visits and area visits: how many of each, and the countries of either."""
    v1 = cities(spark, d).where("id % 3 = 0").select(F.col("id").alias("cityId"), "countryCode")
    v2 = areas(spark, d).where("length(areaId) % 2 = 0").select("areaId", "countryCode")
    return visits.totals(v1, v2)


@query("a10_by_country", f"SELECT countryCode, count(*) AS n, coalesce(sum(population), 0)::BIGINT AS population FROM {CITY} GROUP BY countryCode")
def a10(spark, d):
    return cities(spark, d).groupBy("countryCode").agg(F.count("*").alias("n"), F.coalesce(F.sum("population"), F.lit(0)).alias("population"))


_ALT = f"(SELECT id AS cityId, CASE WHEN len(a) % 2 = 0 THEN 'zh-CN' ELSE 'zh' END AS language, a AS name, len(a) % 3 = 0 AS is_preferred FROM (SELECT id, unnest(aliases) a FROM {CITY}) WHERE a IS NOT NULL)"


@query("a11_preferred_names", f"SELECT cityId, arr[1] AS preferred, array_to_string(arr[2:], '|') AS aliases FROM (SELECT cityId, list(name ORDER BY p, z, name) arr FROM (SELECT cityId, name, min(CASE WHEN is_preferred THEN 0 ELSE 1 END) p, min(CASE WHEN language = 'zh-CN' THEN 0 ELSE 1 END) z FROM {_ALT} GROUP BY ALL) GROUP BY cityId)")
def a11(spark, d):
    a = cities(spark, d).select(F.col("id").alias("cityId"), F.explode("aliases").alias("name")).where("name IS NOT NULL")
    alt = a.select("cityId", F.when(F.length("name") % 2 == 0, "zh-CN").otherwise("zh").alias("language"), "name", (F.length("name") % 3 == 0).alias("is_preferred"))
    return gazetteer.preferred_names(alt).select("cityId", "preferred", F.array_join("aliases", "|").alias("aliases"))


_NOTED = f"(SELECT coalesce(countryCode, '') || '-' || coalesce(admin1, '0') AS areaId, id AS cityId, name AS label, '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') AS createdAt, '2025-01-' || lpad((id % 27 + 1)::VARCHAR, 2, '0') AS updatedAt, CASE WHEN id % 5 > 0 THEN '20' || (id % 20 + 10)::VARCHAR END AS visitedOn, CASE WHEN id % 7 > 0 THEN 'year' END AS datePrecision, asciiName || '!' AS areaSnapshot, CASE WHEN id % 4 = 0 THEN '' ELSE repeat(asciiName, (id % 9 + 1)::INT) END AS note FROM {CITY})"
_FOLD = f"""
WITH RECURSIVE v AS {_NOTED}, l AS (SELECT *, coalesce(label, '') || '：' || note AS line, row_number() OVER (PARTITION BY areaId ORDER BY cityId, updatedAt) AS i FROM v WHERE note <> ''),
f AS (SELECT DISTINCT areaId, 0::BIGINT AS i, '' AS note, false AS taken FROM l UNION ALL SELECT f.areaId, l.i, CASE WHEN fits THEN joined ELSE f.note END, fits FROM f JOIN (SELECT * FROM l) l ON l.areaId = f.areaId AND l.i = f.i + 1, LATERAL (SELECT CASE WHEN f.note = '' THEN l.line ELSE f.note || chr(10) || l.line END AS joined) j, LATERAL (SELECT length(j.joined) <= 500 AS fits) t),
usual AS (SELECT v.* FROM v WHERE note = '' UNION ALL SELECT l.* EXCLUDE (line, i) FROM l JOIN f ON f.areaId = l.areaId AND f.i = l.i AND f.taken),
kept AS (SELECT * FROM usual UNION ALL (SELECT * FROM v WHERE areaId NOT IN (SELECT areaId FROM usual) QUALIFY row_number() OVER (PARTITION BY areaId ORDER BY cityId, updatedAt) = 1))
"""


@query("a14_consolidate", _FOLD + """, n AS (SELECT areaId, count(*) n FROM v GROUP BY 1), t AS (SELECT areaId, arg_max(note, i) AS joined FROM f GROUP BY 1)
SELECT areaId, CASE WHEN n = 1 THEN any_value(k.note) ELSE coalesce(nullif(any_value(t.joined), ''), any_value(k.note)) END AS note, arg_max(cityId, updatedAt || lpad(cityId::VARCHAR, 20, '0')) AS newest_city, arg_max(areaSnapshot, updatedAt || lpad(cityId::VARCHAR, 20, '0')) AS areaSnapshot, min(createdAt) AS createdAt, max(updatedAt) AS updatedAt,
  CASE WHEN n = 1 THEN any_value(visitedOn) ELSE arg_min(visitedOn, visitedOn || lpad(cityId::VARCHAR, 20, '0')) FILTER (visitedOn IS NOT NULL AND datePrecision IS NOT NULL) END AS visitedOn,
  CASE WHEN n = 1 THEN any_value(datePrecision) ELSE arg_min(datePrecision, visitedOn || lpad(cityId::VARCHAR, 20, '0')) FILTER (visitedOn IS NOT NULL AND datePrecision IS NOT NULL) END AS datePrecision
FROM kept k JOIN n USING (areaId) LEFT JOIN t USING (areaId) GROUP BY areaId, n
""")
def a14(spark, d):
    """Visits made of cities, country and region as area, their names in several lengths as notes."""
    return visits.consolidate(_noted(spark, d))


@query("a14_overflow", _FOLD + "SELECT areaId, cityId FROM v WHERE cityId NOT IN (SELECT cityId FROM kept)")
def a14_overflow(spark, d):
    return visits.overflow(_noted(spark, d)).select("areaId", "cityId")


def _noted(spark, d):
    day = lambda head, n: F.concat(F.lit(head), F.lpad((F.col("id") % n + 1).cast("string"), 2, "0"))
    return cities(spark, d).select(
        F.concat(F.coalesce("countryCode", F.lit("")), F.lit("-"), F.coalesce("admin1", F.lit("0"))).alias("areaId"), F.col("id").alias("cityId"), F.col("name").alias("label"),
        day("2024-01-", 28).alias("createdAt"), day("2025-01-", 27).alias("updatedAt"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("20"), (F.col("id") % 20 + 10).cast("string"))).alias("visitedOn"),
        F.when(F.col("id") % 7 > 0, "year").alias("datePrecision"), F.concat("asciiName", F.lit("!")).alias("areaSnapshot"),
        F.when(F.col("id") % 4 == 0, "").otherwise(F.expr("repeat(asciiName, cast(id % 9 + 1 AS int))")).alias("note"),
    )


@query("a17_reasons", "SELECT countryCode, string_agg(DISTINCT code, '|' ORDER BY code) AS reasons FROM (SELECT countryCode, 'CENTRE' code FROM city_area WHERE centroid IS NULL UNION ALL SELECT countryCode, 'NAME' FROM city_area WHERE nameZh IS NULL UNION ALL SELECT countryCode, 'SHAPE' FROM city_area WHERE geometry IS NULL) GROUP BY countryCode")
def a17(spark, d):
    t = table(spark, d, "city_area")
    flags = F.filter(
        F.array(F.when(F.col("centroid").isNull(), "CENTRE"), F.when(F.col("nameZh").isNull(), "NAME"), F.when(F.col("geometry").isNull(), "SHAPE")), lambda x: x.isNotNull()
    )
    return t.select("countryCode", F.explode(flags).alias("code")).groupBy("countryCode").agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("reasons"))


@query("a19_duplicates", "SELECT areaId, count(*) AS n FROM city_area GROUP BY areaId HAVING count(*) > 1")
def a19(spark, d):
    return relational.duplicates(table(spark, d, "city_area"), "areaId")


@query("w1_top_per_group", f"SELECT countryCode, id, population FROM {CITY} QUALIFY row_number() OVER (PARTITION BY countryCode ORDER BY population DESC NULLS LAST, id) = 1")
def w1(spark, d):
    return relational.first_by(cities(spark, d), ["countryCode"], F.col("population").desc_nulls_last(), F.col("id")).select("countryCode", "id", "population")


@query("w2_first_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def w2(spark, d):
    return relational.first_by(table(spark, d, "events"), ["user_id"], F.col("event_id")).select("user_id", "event_id", "event_type")


@query("w4_history", f"SELECT key, row_number() OVER (ORDER BY stamp DESC, key) AS position, ceil(row_number() OVER (ORDER BY stamp DESC, key) / 6)::BIGINT AS page FROM (SELECT 'o' || o_orderkey AS key, o_orderdate AS stamp FROM orders UNION ALL SELECT 'e' || event_id, ts FROM events)")
def w4(spark, d):
    """Two sources in one order."""
    return visits.history(_entries(spark, d), "stamp", "key").select("key", "position", "page")


@query("w4_last_page", f"SELECT key, position FROM (SELECT key, row_number() OVER (ORDER BY stamp DESC, key) AS position, count(*) OVER () AS n FROM (SELECT 'o' || o_orderkey AS key, o_orderdate AS stamp FROM orders UNION ALL SELECT 'e' || event_id, ts FROM events)) WHERE ceil(position / 6) = ceil(n / 6)")
def w4_page(spark, d):
    """A page beyond the last is the last."""
    return visits.page(visits.history(_entries(spark, d), "stamp", "key"), 1 << 40).select("key", "position")


def _entries(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderdate").cast("timestamp_ntz").alias("stamp"))
    return o.unionByName(table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"), F.col("ts").cast("timestamp_ntz").alias("stamp")))


@query("o1_o2_ordered", "SELECT *, row_number() OVER (ORDER BY countryCode NULLS FIRST, source NULLS FIRST, adminLevel NULLS FIRST) AS position FROM (SELECT countryCode, source, adminLevel, count(*) AS n FROM city_area GROUP BY ALL)")
def o1_o2(spark, d):
    t = table(spark, d, "city_area").groupBy("countryCode", "source", "adminLevel").agg(F.count("*").alias("n"))
    return relational.positions(t.orderBy(*[F.asc_nulls_first(c) for c in ("countryCode", "source", "adminLevel")]))


def _term_rank(q):
    keys = [f"lower(strip_accents({c}))" for c in ("name", "asciiName", "zhName")]
    key = lambda e: f"trim(regexp_replace({e}, '[\\p{{P}}\\p{{Z}}]+', ' ', 'g'))"
    rank = lambda e: f"CASE WHEN {e} = '{q}' THEN 0 WHEN starts_with({e}, '{q}') THEN 1 WHEN contains({e}, '{q}') THEN 2 END"
    alias = f"(SELECT min({rank('k')}) FROM (SELECT {key('lower(strip_accents(a))')} k FROM (SELECT unnest(coalesce(aliases, [])) a)))"
    return f"least({', '.join(rank(key(k)) for k in keys)}, {alias})"


@query("o3_search_cities", f"SELECT id, match_rank FROM (SELECT id, name, population, {_term_rank('san')} AS match_rank FROM {CITY}) WHERE match_rank IS NOT NULL ORDER BY match_rank, coalesce(population, 0) DESC, name, id LIMIT 12")
def o3(spark, d):
    return gazetteer.search_cities(cities(spark, d), " SAN ", 12).select("id", "match_rank")


@query("o4_search_areas", f"""
WITH a AS (SELECT areaId, coalesce(nameZh, nameLocal) AS shown, list_filter(u, lambda x, i: list_position(u, x) = i) AS names FROM (SELECT areaId, nameZh, nameLocal, list_filter(list_concat([nameZh, nameLocal], coalesce(aliases, [])), lambda x: x IS NOT NULL) AS u FROM {AREA})),
k AS (SELECT areaId, shown, unnest(names) AS matched_name, unnest(range(0, len(names)))::INT AS field_rank FROM a),
r AS (SELECT *, CASE WHEN t = 'ber' THEN 0 WHEN starts_with(t, 'ber') THEN 1 WHEN contains(t, 'ber') THEN 2 END AS match_rank FROM (SELECT *, {_plain('matched_name')} AS t FROM k)),
b AS (SELECT areaId, shown, match_rank, field_rank, matched_name FROM r WHERE match_rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY areaId ORDER BY match_rank, field_rank) = 1)
SELECT areaId, match_rank, field_rank, matched_name, row_number() OVER (ORDER BY match_rank, field_rank, shown COLLATE zh, areaId COLLATE en) AS position FROM b ORDER BY position LIMIT 50
""")
def o4(spark, d):
    return relational.positions(gazetteer.search_areas(areas(spark, d), "ber", 50).select("areaId", "match_rank", "field_rank", "matched_name"))


@query("o6_locale_order", "SELECT v, row_number() OVER (ORDER BY v COLLATE en, v) AS position FROM (SELECT DISTINCT unnest([areaId, adminLevel, countryCode]) AS v FROM city_area) WHERE v IS NOT NULL")
def o6(spark, d):
    v = table(spark, d, "city_area").select(F.explode(F.array("areaId", "adminLevel", "countryCode")).alias("v")).where("v IS NOT NULL").distinct()
    return relational.positions(v.orderBy(F.collate("v", "en"), "v"))


@query("o8_drawing_order", f"SELECT areaId, row_number() OVER (ORDER BY round(w * h, 9) DESC, areaId) AS position FROM (SELECT areaId, list_max(xs) - list_min(xs) AS w, list_max(ys) - list_min(ys) AS h FROM (SELECT areaId, list_transform(flatten(flatten(geometry)), lambda p: p.x) xs, list_transform(flatten(flatten(geometry)), lambda p: p.y) ys FROM {AREA} WHERE geometry IS NOT NULL))")
def o8(spark, d):
    """Large areas first, so that small ones are drawn over them."""
    b = geo.bounds(F.col("geometry"))
    size = F.round((b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]), 9)
    return relational.positions(areas(spark, d).where("geometry IS NOT NULL").select("areaId", size.alias("size")).orderBy(F.desc("size"), "areaId")).drop("size")


@query("o10_by_city_and_status", f"SELECT id, status, row_number() OVER (ORDER BY id, status) AS position FROM (SELECT id, unnest(['outside', 'ambiguous']) AS status FROM {CITY})")
def o10(spark, d):
    s = cities(spark, d).select("id", F.explode(F.array(F.lit("outside"), F.lit("ambiguous"))).alias("status"))
    return relational.positions(s.orderBy("id", "status"))


@query("u2_union", "SELECT countryCode FROM city_area UNION SELECT countryCode FROM city_summary")
def u2(spark, d):
    return table(spark, d, "city_area").select("countryCode").union(table(spark, d, "city_summary").select("countryCode")).distinct()


@query("u3_u4_difference", "SELECT 'except' AS kind, packageId FROM (SELECT packageId FROM country_manifest EXCEPT SELECT packageId FROM city_area) UNION ALL SELECT 'intersect', packageId FROM (SELECT packageId FROM country_manifest INTERSECT SELECT packageId FROM city_area)")
def u3_u4(spark, d):
    m, a = table(spark, d, "country_manifest").select("packageId"), table(spark, d, "city_area").select("packageId")
    return m.subtract(a).select(F.lit("except").alias("kind"), "packageId").union(m.intersect(a).select(F.lit("intersect").alias("kind"), "packageId"))


@query("u5_set_equality", f"SELECT coalesce(a.countryCode, b.countryCode) AS countryCode, coalesce(a.s = b.s, false) AS same FROM (SELECT countryCode, list_sort(list(DISTINCT areaId)) s FROM {REL} WHERE countryCode IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT countryCode, list_sort(list(DISTINCT areaId)) s FROM {PRE} WHERE countryCode IS NOT NULL GROUP BY 1) b USING (countryCode)")
def u5(spark, d):
    """Countries whose areas are the same set in both releases."""
    return relational.equal_sets(release(spark, d, LATEST), release(spark, d, BEFORE), "countryCode", "areaId")


@query("u6_distinct_names", f"SELECT areaId, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') AS names FROM (SELECT areaId, list_filter(list_transform(list_concat([nameZh, nameLocal], coalesce(aliases, [])), lambda x: trim(x)), lambda x: x <> '') k FROM {AREA})")
def u6(spark, d):
    names = F.concat(F.array("nameZh", "nameLocal"), F.coalesce("aliases", F.array().cast("array<string>")))
    kept = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))
    return areas(spark, d).select("areaId", F.array_join(kept, "|").alias("names"))


@query("u7_k14_replace_part", f"SELECT areaId, countryCode, 'kept' AS origin FROM {AREA} WHERE countryCode IS DISTINCT FROM 'XK' UNION ALL SELECT areaId, countryCode, 'new' FROM {REL} WHERE countryCode = 'XK'")
def u7(spark, d):
    old = areas(spark, d).select("areaId", "countryCode", F.lit("kept").alias("origin"))
    new = release(spark, d, LATEST).where("countryCode = 'XK'").select("areaId", "countryCode", F.lit("new").alias("origin"))
    return relational.replace_part(old, new, "countryCode", "XK")


@query("m1_last_writer_wins", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2, event_id) = 1")
def m1(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    cur, inc = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return relational.last_writer_wins(cur, inc, ["user_id"], "ts").drop("ts")


@query("m1_stream_merge", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def m1_stream(spark, d):
    from cartomill.sources import writers
    from cartomill.sources.streams import table_stream
    from cartomill.streaming import merge

    stream = table_stream(spark, d, "events").select("user_id", "event_id", "value", "ts")
    at = writers.scratch(spark)
    merge.upsert_stream(stream, f"{at}/table", ["user_id"], "ts", f"{at}/offsets")
    return merge.latest(spark, f"{at}/table", stream.schema).select("user_id", "event_id", "value")


@query("s20_s25_store", f"SELECT k, v, row_number() OVER (ORDER BY k COLLATE en, k) AS position FROM (SELECT areaId AS k, 'new' AS v FROM {AREA} WHERE countryCode = 'XK' UNION ALL SELECT areaId, 'old' FROM {AREA} WHERE countryCode IS DISTINCT FROM 'XK' AND adminLevel IS DISTINCT FROM 'county')")
def s20(spark, d):
    """Areas of one country put anew after those of one level were deleted, listed in order."""
    a = areas(spark, d).select(F.col("areaId").alias("k"), "countryCode", "adminLevel")
    kept = store.delete(a.select("k", F.lit("old").alias("v")), a.where("adminLevel = 'county'").select("k"), "k")
    return relational.positions(store.listed(store.put(kept, a.where("countryCode = 'XK'").select("k", F.lit("new").alias("v")), "k"), "k"))


@query("s20_get_f11", f"SELECT areaId, countryCode FROM {AREA} WHERE countryCode IN ('XA', 'XB')")
def s20_get(spark, d):
    return store.get(areas(spark, d).select("areaId", "countryCode"), "countryCode", ["XA", "XB"])


@query("proj9_visit_snapshot", f"SELECT areaId, countryCode || '/' || sourceId || '/' || coalesce(nameZh, nameLocal, '') AS shown, len(coalesce(aliases, [])) AS aliases, round(centroid.x, 6) AS x FROM {AREA} WHERE countryCode <> 'XK'")
def proj9(spark, d):
    a = areas(spark, d)
    none = F.lit(None).cast("string")
    v = a.where("countryCode <> 'XK'").select("areaId", F.lit("2026").alias("createdAt"), F.lit("2026").alias("updatedAt"), none.alias("visitedOn"), none.alias("datePrecision"), none.alias("note"))
    s = F.col("areaSnapshot")
    shown = F.concat_ws("/", s["countryCode"], s["sourceId"], F.coalesce(s["nameZh"], s["nameLocal"], F.lit("")))
    return visits.area_visits(v, a).select("areaId", shown.alias("shown"), F.size(s["aliases"]).cast("bigint").alias("aliases"), F.round(s["centroid"]["x"], 6).alias("x"))


_BACKUP = f"(SELECT id AS cityId, CASE WHEN id % 11 = 0 THEN '2026-01-01' ELSE '2026-01-02T00:00:00.000Z' END AS createdAt, CASE WHEN id % 7 = 0 THEN '2026-01-01T00:00:00.000Z' ELSE '2026-01-03T00:00:00.000Z' END AS updatedAt, CASE WHEN id % 3 = 0 THEN '2026-02-30' ELSE '2026-02' END AS visitedOn, 'month' AS datePrecision, repeat('n', (id % 600 + 1)::INT) AS note FROM city_summary)"


@query("v16_backup_codes", f"WITH v AS {_BACKUP} SELECT DISTINCT cityId::VARCHAR AS subject, unnest(list_filter([CASE WHEN length(createdAt) < 24 THEN 'TIMESTAMP_INVALID' END, CASE WHEN length(createdAt) = 24 AND updatedAt < createdAt THEN 'UPDATED_BEFORE_CREATED' END, CASE WHEN visitedOn = '2026-02-30' THEN 'DATE_INVALID' END, CASE WHEN length(note) > 500 THEN 'NOTE_INVALID' END], lambda c: c IS NOT NULL)) AS code FROM v UNION ALL SELECT cityId::VARCHAR, 'VISIT_DUPLICATE' FROM v GROUP BY cityId HAVING count(*) > 1 UNION ALL SELECT NULL, 'TOO_MANY_VISITS' FROM v HAVING count(*) > 10000")
def v16(spark, d):
    """A backup of visits to all rows of the gazetteer, some with faults of each kind, without boundaries."""
    k = F.col("id")
    stamp = lambda day: F.lit(f"2026-01-{day:02}T00:00:00.000Z")
    v = table(spark, d, "city_summary").select(
        k.alias("cityId"), F.when(k % 11 == 0, "2026-01-01").otherwise(stamp(2)).alias("createdAt"), F.when(k % 7 == 0, stamp(1)).otherwise(stamp(3)).alias("updatedAt"),
        F.when(k % 3 == 0, "2026-02-30").otherwise("2026-02").alias("visitedOn"), F.lit("month").alias("datePrecision"), F.expr("repeat('n', cast(id % 600 + 1 AS int))").alias("note"),
    )
    none = areas(spark, d).where(F.lit(False)).select(F.lit(1).cast("bigint").alias("cityId"), "geometry")
    return visits.backup_codes(v, none)
