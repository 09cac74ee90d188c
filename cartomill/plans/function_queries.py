"""Queries of scalar functions: text, dates, numbers, arrays, maps, JSON, hashes, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators import nearby, regions
from cartomill.plans.base import AREA, CAND, CITY, LATEST, USABLE, areas, candidates, cities, query, release
from cartomill.runtime import table
from cartomill.sources import readers


@query("x1_x3_keys", f"SELECT id, trim(regexp_replace(lower(strip_accents(name)), '[\\p{{P}}\\p{{Z}}]+', ' ', 'g')) AS city_key, regexp_replace(trim(lower(strip_accents(name))), '\\s+', ' ', 'g') AS area_key, lower(trim(strip_accents(name))) AS candidate_key FROM {CITY}")
def x1_x3(spark, d):
    n = F.col("name")
    return cities(spark, d).select("id", text.search_key(n).alias("city_key"), text.area_key(n).alias("area_key"), text.candidate_key(n).alias("candidate_key"))


@query("x4_match_rank", f"SELECT id, CASE WHEN lower(asciiName) = 'san' THEN 0 WHEN starts_with(lower(asciiName), 'san') THEN 1 WHEN contains(lower(asciiName), 'san') THEN 2 END AS match_rank FROM {CITY}")
def x4(spark, d):
    return cities(spark, d).select("id", text.match_rank(F.lower("asciiName"), F.lit("san")).alias("match_rank"))


@query("x5_x7_bounded", "SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 500 AND NOT regexp_matches(t, '[\\x00-\\x1f\\x7f]') THEN t END AS kept FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\A[\\t-\\r\\p{Z}\\x{feff}]+|[\\t-\\r\\p{Z}\\x{feff}]+\\z', '', 'g') t FROM documents)")
def x5_x7_all(spark, d):
    return table(spark, d, "documents").select("doc_id", text.bounded(F.coalesce("text", F.lit("")), 500).alias("kept"))


@query("x6_control", "SELECT doc_id, regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS control FROM documents WHERE text IS NOT NULL")
def x6(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.has_control(F.col("text")).alias("control"))


@query("x8_truncated", f"SELECT id, CASE WHEN length(name) > 8 THEN name[1:7] || '…' ELSE name END AS short FROM {CITY}")
def x8(spark, d):
    return cities(spark, d).select("id", text.truncated(F.col("name"), 8).alias("short"))


_ESCAPED = "replace(replace(replace(replace(replace(regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("x9_xml", f"SELECT doc_id, {_ESCAPED.format(c='headers')} AS headers, sha256({_ESCAPED.format(c='text')}) AS text FROM documents")
def x9(spark, d):
    """Of every header block and text, those with forbidden code points too."""
    return table(spark, d, "documents").select("doc_id", text.xml_escaped(F.col("headers")).alias("headers"), F.sha2(text.xml_escaped(F.col("text")), 256).alias("text"))


@query("x9_html_json", "SELECT doc_id, sha256(replace(replace(replace(replace(replace(headers, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS safe FROM documents")
def x9_html(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.html_safe_json(F.col("headers")), 256).alias("safe"))


@query("x11_forms", "SELECT boundaryRelease, packageId, loadedAt, coalesce(regexp_full_match(checksum, '[0-9a-f]{64}'), false) AS sha256, coalesce(regexp_full_match(checksum, '[0-9a-f]{7,40}'), false) AS commit_id, coalesce(regexp_full_match(countryCode, '[A-Z]{2}'), false) AS iso2, coalesce(regexp_full_match(boundaryVersion, '[0-9]{4}-[0-9]{2}-[0-9]{2}\\.[0-9]+'), false) AS release FROM country_manifest")
def x11(spark, d):
    form = lambda c, name, out: text.is_form(F.col(c), name).alias(out)
    return table(spark, d, "country_manifest").select(
        "boundaryRelease", "packageId", "loadedAt", form("checksum", "sha256", "sha256"), form("checksum", "commit", "commit_id"), form("countryCode", "iso2", "iso2"), form("boundaryVersion", "release", "release")
    )


@query("x15_secrets", "SELECT doc_id, regexp_matches(x, '(^|[\\s\"''(=:,])(/(Users|home|root|tmp|var|etc|opt|mnt|private)/|[A-Za-z]:\\\\\\\\)') AS path, regexp_matches(x, '(?i)(api[_-]?key|access[_-]?token|secret|passwo?r?d|authorization|private[_-]?key)\\s*[:=]') AS secret, regexp_matches(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}') AS stamp FROM (SELECT doc_id, coalesce(headers, '') || chr(10) || coalesce(text, '') AS x FROM documents)")
def x15(spark, d):
    f = text.secret_findings(F.concat_ws("\n", F.coalesce("headers", F.lit("")), F.coalesce("text", F.lit(""))))
    has = lambda n, out: F.array_contains("f", n).alias(out)
    return table(spark, d, "documents").select("doc_id", f.alias("f")).select("doc_id", has("absolute-path", "path"), has("secret-key", "secret"), has("timestamp", "stamp"))


@query("x10_x13_area_id", f"SELECT areaId, split_part(areaId, ':', 1) AS country, split_part(areaId, ':', 2) AS source_part, split_part(areaId, ':', 3) AS id_part, areaId = countryCode || ':' || source || ':' || sourceId AS consistent FROM {AREA}")
def x10_x13(spark, d):
    part = lambda i: F.split_part("areaId", F.lit(":"), F.lit(i))
    built = text.area_id(F.col("countryCode"), F.col("source"), F.col("sourceId"))
    return areas(spark, d).select("areaId", part(1).alias("country"), part(2).alias("source_part"), part(3).alias("id_part"), (F.col("areaId") == built).alias("consistent"))


@query("x14_country_code", "SELECT id, CASE WHEN regexp_full_match(upper(trim(countryCode)), '[A-Z]{2}') THEN upper(trim(countryCode)) END AS code FROM (SELECT DISTINCT ON (id) * FROM boundary_candidate)")
def x14(spark, d):
    return candidates(spark, d).select("id", text.country_code(F.col("countryCode")).alias("code"))


@query("d1_precision", "SELECT d, CASE WHEN regexp_full_match(d, '[0-9]{4}') THEN 'year' WHEN regexp_full_match(d, '[0-9]{4}-(0[1-9]|1[0-2])') THEN 'month' WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(d, '%Y-%m-%d') IS NOT NULL THEN 'day' END AS precision FROM (SELECT DISTINCT unnest([u, u[1:7], u[1:4], u[1:8] || '31', u[1:5] || '13', u || 'T00:00:00Z', ' ' || u[1:4], '']) AS d FROM (SELECT DISTINCT updatedAt[1:10] AS u FROM country_manifest WHERE updatedAt IS NOT NULL))")
def d1(spark, d):
    """Dates, and forms that are none."""
    u = F.substring("updatedAt", 1, 10)
    sub = lambda n: F.substring("u", 1, n)
    forms = F.array(F.col("u"), sub(7), sub(4), F.concat(sub(8), F.lit("31")), F.concat(sub(5), F.lit("13")), F.concat("u", F.lit("T00:00:00Z")), F.concat(F.lit(" "), sub(4)), F.lit(""))
    rows = table(spark, d, "country_manifest").where("updatedAt IS NOT NULL").select(u.alias("u")).distinct()
    return rows.select(F.explode(forms).alias("d")).distinct().select("d", text.date_precision(F.col("d")).alias("precision"))


@query("d2_release_ids", "SELECT DISTINCT boundaryVersion, CASE WHEN regexp_full_match(boundaryVersion, '[0-9]{4}-[0-9]{2}-[0-9]{2}\\.[0-9]+') AND try_strptime(boundaryVersion[1:10], '%Y-%m-%d') IS NOT NULL THEN boundaryVersion END AS release FROM country_manifest")
def d2(spark, d):
    return table(spark, d, "country_manifest").select("boundaryVersion").distinct().select("boundaryVersion", text.release_id(F.col("boundaryVersion")).alias("release"))


_SAID = "(strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('millisecond', ts)::INT % 1000)::VARCHAR, 3, '0'))"


@query("d3_d5_instants", f"SELECT event_id, said, CASE WHEN event_id % 4 = 0 THEN date_trunc('millisecond', ts) END AS instant, CASE WHEN event_id % 4 = 0 THEN hour(ts) < 12 END AS in_order FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN {_SAID} || 'Z' WHEN 1 THEN {_SAID} WHEN 2 THEN {_SAID}[1:5] || '13' || {_SAID}[8:] || 'Z' ELSE {_SAID}[1:19] || 'Z' END AS said FROM events)")
def d3_d5(spark, d):
    """Instants of the one canonical form, null for others; and whether noon of the day, an update, is not before them."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    kind = F.col("event_id") % 4
    said = (
        F.when(kind == 0, F.concat(stamp, F.lit("Z"))).when(kind == 1, stamp).when(kind == 2, F.concat(F.substring(stamp, 1, 5), F.lit("13"), F.substring(stamp, 8, 99), F.lit("Z")))
        .otherwise(F.concat(F.substring(stamp, 1, 19), F.lit("Z")))
    )
    noon = F.concat(F.substring("said", 1, 10), F.lit("T11:59:59.999Z"))
    rows = table(spark, d, "events").withColumn("said", said)
    return rows.select("event_id", "said", text.utc_instant(F.col("said")).cast("timestamp_ntz").alias("instant"), text.updated_in_order(F.col("said"), noon).alias("in_order"))


@query("n1_n9_numbers", f"SELECT id, least(85.0, greatest(-85.0, lat)) AS clamped, round((((lon + 180) % 360) + 360) % 360 - 180, 6) AS wrapped, round(lat, 3) AS rounded, isfinite(lat) AS finite, sign(lat)::DOUBLE AS sgn, round(sqrt(lat * lat + lon * lon), 6) AS dist, greatest(0, floor(lat))::BIGINT AS shown FROM {CITY} WHERE {USABLE}")
def n1_n9(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return cities(spark, d).where(nearby.usable(lat, lon)).select(
        "id", F.least(F.lit(85.0), F.greatest(F.lit(-85.0), lat)).alias("clamped"), F.round(geo.wrapped(lon), 6).alias("wrapped"), F.round(lat, 3).alias("rounded"),
        (~F.isnan(lat) & (F.abs(lat) < F.lit(float("inf")))).alias("finite"), F.signum(lat).alias("sgn"), F.round(F.hypot(lat, lon), 6).alias("dist"),
        F.greatest(F.lit(0), F.floor(lat)).cast("bigint").alias("shown"),
    )


@query("n6_whole_numbers", "SELECT record_no, coalesce(regexp_full_match(f, '[0-9]{1,38}') AND try_cast(f AS hugeint) <= 9007199254740991, false) AS whole FROM (SELECT record_no, split_part(split_part(record, chr(9), 1), ',', 1) f FROM city_raw)")
def n6(spark, d):
    first = F.split_part(F.split_part("record", F.lit("\t"), F.lit(1)), F.lit(","), F.lit(1))
    return table(spark, d, "city_raw").select("record_no", text.is_whole(first).alias("whole"))


@query("r1_r11_arrays", f"SELECT areaId, len(k) AS n, array_to_string(k[1:2], '|') AS first_two, array_to_string(list_reverse(k), '|') AS backwards, k[-1] AS last, list_contains(k, nameLocal) AS has_local, array_to_string(list_sort(k), '|') AS sorted FROM (SELECT areaId, nameLocal, coalesce(aliases, []) k FROM {AREA})")
def r1_r11(spark, d):
    k = F.col("k")
    return areas(spark, d).select("areaId", "nameLocal", F.coalesce("aliases", F.array().cast("array<string>")).alias("k")).select(
        "areaId", F.size(k).cast("bigint").alias("n"), F.array_join(F.slice(k, 1, 2), "|").alias("first_two"), F.array_join(F.reverse(k), "|").alias("backwards"),
        F.try_element_at(k, F.lit(-1)).alias("last"), F.array_contains(k, F.col("nameLocal")).alias("has_local"), F.array_join(F.array_sort(k), "|").alias("sorted"),
    )


@query("mp1_mp3_maps", "SELECT countryCode, string_agg(adminLevel || '=' || n, ';' ORDER BY adminLevel) AS levels, coalesce(max(n) FILTER (adminLevel = 'county'), 0) AS county FROM (SELECT countryCode, adminLevel, count(*) n FROM city_area WHERE adminLevel IS NOT NULL GROUP BY ALL) GROUP BY countryCode")
def mp1_mp3(spark, d):
    n = table(spark, d, "city_area").where("adminLevel IS NOT NULL").groupBy("countryCode", "adminLevel").agg(F.count("*").alias("n"))
    m = n.groupBy("countryCode").agg(F.map_from_entries(F.collect_list(F.struct("adminLevel", "n"))).alias("m"))
    text_of = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return m.select("countryCode", text_of.alias("levels"), F.coalesce(F.try_element_at("m", F.lit("county")), F.lit(0)).alias("county"))


@query("js1_js3_json", "SELECT event_id, (props->>'$.k')::INT AS k, '{\"event_id\":' || event_id || ',\"k\":' || (props->>'$.k') || '}' AS canonical, true AS same, false AS other_same FROM events")
def js1_js3(spark, d):
    """Text of the keys in order, and equality of documents by it: keys turned round are equal, another value is not."""
    k = F.from_json("props", "k int")["k"]
    told = lambda *cols: text.canonical_text(F.to_json(F.struct(*cols)))
    here, turned = told("event_id", k.alias("k")), told(k.alias("k"), "event_id")
    return table(spark, d, "events").select("event_id", k.alias("k"), here.alias("canonical"), (here == turned).alias("same"), (here == told("event_id", (k + 1).alias("k"))).alias("other_same"))


@query("mp2_map_merge", "SELECT areaId, countryCode || '/' || coalesce(adminLevel, 'none') || '/' || source AS merged FROM " + AREA)
def mp2(spark, d):
    """Later maps win: defaults, then what a row gives."""
    defaults = F.create_map(*[F.lit(x) for x in ("country", "none", "level", "none", "source", "none")])
    own = F.map_from_arrays(F.array(F.lit("country"), F.lit("level"), F.lit("source")), F.array("countryCode", "adminLevel", "source"))
    m = text.merged_maps(defaults, F.map_filter(own, lambda k, v: v.isNotNull()))
    return areas(spark, d).select("areaId", F.concat_ws("/", *[F.element_at(m, k) for k in ("country", "level", "source")]).alias("merged"))


@query("n8_orientation", f"SELECT id, CASE WHEN abs(cross_) < 1e-12 THEN 0 ELSE sign(cross_) END::INT AS side FROM (SELECT id, (10.0 - 0.0) * (lat - 0.0) - (10.0 - 0.0) * (lon - 0.0) AS cross_ FROM {CITY} WHERE {USABLE})")
def n8(spark, d):
    """Which side of the line from 0, 0 to 10, 10 a place lies on."""
    lit = lambda v: F.lit(float(v))
    c = cities(spark, d).where(nearby.usable(F.col("lat"), F.col("lon")))
    return c.select("id", geo.orientation(lit(0), lit(0), lit(10), lit(10), F.col("lon"), F.col("lat")).alias("side"))


@query("h1_sha256", f"SELECT areaId, sha256(areaId || coalesce(nameLocal, '')) AS digest FROM {AREA}")
def h1(spark, d):
    return areas(spark, d).select("areaId", F.sha2(F.concat("areaId", F.coalesce("nameLocal", F.lit(""))), 256).alias("digest"))


@query("c2_c3_assertion", "SELECT count(*) AS checked FROM city_area WHERE countryCode IN (SELECT countryCode FROM country_info)")
def c2_c3(spark, d):
    """Fails if a delivery holds a country that is not known."""
    known = table(spark, d, "country_info").select("countryCode").distinct().withColumn("_k", F.lit(True))
    rows = table(spark, d, "city_area").join(known, "countryCode", "left")
    return rows.where(F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("unknown country: "), F.col("countryCode")))).otherwise(True)).agg(F.count("*").alias("checked"))


@query("c3_scalar_subquery", "SELECT (SELECT count(*) FROM city_area WHERE countryCode IS NOT NULL) = (SELECT count(*) FROM city_area) AS complete, (SELECT count(DISTINCT countryCode) FROM city_area) > 1 AS several")
def c3(spark, d):
    return spark.sql(
        "SELECT (SELECT count(*) FROM {a} WHERE countryCode IS NOT NULL) = (SELECT count(*) FROM {a}) AS complete, (SELECT count(DISTINCT countryCode) FROM {a}) > 1 AS several",
        a=table(spark, d, "city_area"),
    )


@query("g1_g4_grid", f"SELECT id, least(35, greatest(0, floor((lat + 90) / 5)))::INT AS grid_row, least(71, greatest(0, floor(((((lon + 180) % 360) + 360) % 360) / 5)))::INT AS grid_column, round(greatest(0, 0 - lat, lat - 5) * pi() / 180 * 6371.0088, 6) AS to_row_18 FROM {CITY} WHERE {USABLE}")
def g1_g4(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return cities(spark, d).where(nearby.usable(lat, lon)).select(
        "id", geo.grid_row(lat).alias("grid_row"), geo.grid_column(lon).alias("grid_column"), F.round(geo.row_distance(lat, F.lit(18)), 6).alias("to_row_18")
    )


@query("g2_haversine", f"SELECT id, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - 48.1) / 2), 2) + cos(radians(48.1)) * cos(radians(lat)) * pow(sin(radians(lon - 11.5) / 2), 2)))), 6) AS km FROM {CITY} WHERE {USABLE}")
def g2(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return cities(spark, d).where(nearby.usable(lat, lon)).select("id", F.round(geo.haversine(F.lit(48.1), F.lit(11.5), lat, lon), 6).alias("km"))


@query("g5_mercator", f"SELECT id, round((lon + 180) / 360, 9) AS x, round((1 - asinh(tan(radians(greatest(-85.05112878, least(85.05112878, lat))))) / pi()) / 2, 9) AS y, round(greatest(-85.05112878, least(85.05112878, lat)), 7) AS back FROM {CITY} WHERE {USABLE}")
def g5(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    y = geo.mercator_y(lat)
    return cities(spark, d).where(nearby.usable(lat, lon)).select(
        "id", F.round(geo.mercator_x(lon), 9).alias("x"), F.round(y, 9).alias("y"), F.round(geo.mercator_lat(y), 7).alias("back")
    )


_SHAPES = f"(SELECT areaId, geometry FROM {AREA} WHERE geometry IS NOT NULL)"


@query("a12_a15_bounds", f"SELECT areaId, list_min(xs) AS min_x, list_min(ys) AS min_y, list_max(xs) AS max_x, list_max(ys) AS max_y, len(xs)::INT AS vertices FROM (SELECT areaId, list_transform(flatten(flatten(geometry)), lambda p: p.x) xs, list_transform(flatten(flatten(geometry)), lambda p: p.y) ys FROM {_SHAPES})")
def a12_a15(spark, d):
    g = F.col("geometry")
    return areas(spark, d).where("geometry IS NOT NULL").select("areaId", *[c.alias(n) for n, c in geo.bounds(g).items()], geo.vertices(g).alias("vertices"))


@query("a13_g16_centroid", f"SELECT areaId, round(degrees(atan2(sum(sin(radians(p.x))), sum(cos(radians(p.x))))), 6) + 0.0 AS x, round(avg(p.y), 6) + 0.0 AS y FROM (SELECT areaId, unnest(o[1][:-2]) p FROM (SELECT areaId, unnest(geometry) o FROM {_SHAPES})) GROUP BY areaId")
def a13(spark, d):
    x, y = geo.centroid(F.col("geometry"))
    return areas(spark, d).where("geometry IS NOT NULL").select("areaId", x.alias("x"), y.alias("y"))


#: Points of rings (keys, no, p) as rings of (keys, no, p, x): each x within half a turn of the one before.
_UNWRAPPED = "(SELECT *, p.x + 360 * coalesce(sum(turn) OVER (PARTITION BY {keys} ORDER BY no), 0) AS x FROM (SELECT *, CASE WHEN p.x - lag(p.x) OVER w > 180 THEN -1 WHEN p.x - lag(p.x) OVER w < -180 THEN 1 ELSE 0 END AS turn FROM {points} WINDOW w AS (PARTITION BY {keys} ORDER BY no)))"
_AREAS = "(SELECT {keys}, coalesce(sum(x * y2 - x2 * y), 0) / 2 AS area FROM (SELECT {keys}, x, p.y AS y, lead(x) OVER w AS x2, lead(p.y) OVER w AS y2 FROM " + _UNWRAPPED + " WINDOW w AS (PARTITION BY {keys} ORDER BY no)) GROUP BY ALL)"
_CAND_POINTS = f"(SELECT id, unnest(geometry[1][1]) AS p, unnest(range(1, len(geometry[1][1]) + 1)) AS no FROM {CAND} WHERE geometry IS NOT NULL)"
_AREA_RINGS = f"(SELECT areaId, polygon, unnest(rings) AS ring, unnest(range(1, len(rings) + 1))::INT AS ring_no FROM (SELECT areaId, unnest(geometry) AS rings, unnest(range(1, len(geometry) + 1))::INT AS polygon FROM {_SHAPES}))"
_AREA_POINTS = f"(SELECT areaId, polygon, ring_no, unnest(ring) AS p, unnest(range(1, len(ring) + 1)) AS no FROM {_AREA_RINGS})"


@query("a20_ring_area", "SELECT id, round(area, 6) + 0.0 AS area FROM " + _AREAS.format(keys="id", points=_CAND_POINTS))
def a20_all(spark, d):
    c = candidates(spark, d).where("geometry IS NOT NULL")
    return c.select("id", (F.round(geo.ring_area(F.col("geometry")[0][0]), 6) + F.lit(0.0)).alias("area"))


_BROKEN = "len(list_filter(r, lambda q: q.x IS NULL OR q.y IS NULL OR isnan(q.x) OR isnan(q.y) OR abs(q.x) > 180 OR abs(q.y) > 90)) > 0"


@query("g6_problems", "SELECT s.areaId, CASE WHEN s.geometry IS NULL THEN 'GEOMETRY_TYPE_INVALID' ELSE coalesce((SELECT string_agg(code, '|' ORDER BY code) FROM (SELECT DISTINCT unnest(codes) AS code FROM (SELECT CASE WHEN len(ring) < 4 THEN ['RING_TOO_SHORT'] WHEN broken THEN ['COORDINATE_INVALID'] ELSE list_filter([CASE WHEN ring[1].x <> ring[-1].x OR ring[1].y <> ring[-1].y THEN 'RING_NOT_CLOSED' END, CASE WHEN area = 0 THEN 'RING_ZERO_AREA' END], lambda c: c IS NOT NULL) END AS codes FROM (SELECT r.ring, " + _BROKEN.replace("list_filter(r,", "list_filter(r.ring,") + " AS broken, t.area FROM " + _AREA_RINGS + " r JOIN " + _AREAS.format(keys="areaId, polygon, ring_no", points=_AREA_POINTS) + f" t USING (areaId, polygon, ring_no) WHERE r.areaId = s.areaId)))), CASE WHEN len(s.geometry) = 0 THEN 'GEOMETRY_EMPTY' ELSE '' END) END AS codes FROM {AREA} s")
def g6(spark, d):
    return areas(spark, d).select("areaId", F.array_join(geo.problems(F.col("geometry")), "|").alias("codes"))


@query("g7_unwrapped", "SELECT areaId, polygon, ring_no, round(max(x) - min(x), 6) AS width FROM " + _UNWRAPPED.format(keys="areaId, polygon, ring_no", points=_AREA_POINTS) + " GROUP BY ALL")
def g7(spark, d):
    """Of every ring of every area."""
    xs = F.transform(geo.unwrapped(F.col("ring")), lambda p: p["x"])
    return _rings(areas(spark, d)).select("areaId", "polygon", "ring_no", F.round(F.array_max(xs) - F.array_min(xs), 6).alias("width"))


def _rings(a):
    """(areaId, polygon, ring_no, ring), numbers from 1."""
    g = a.where("geometry IS NOT NULL").select("areaId", F.posexplode("geometry").alias("polygon", "rings"))
    return g.select("areaId", (F.col("polygon") + 1).alias("polygon"), F.posexplode("rings").alias("ring_no", "ring")).withColumn("ring_no", F.col("ring_no") + 1)


@query("g17_span", "SELECT areaId, round(max(x) - min(x), 6) AS span_x, round(max(y) - min(y), 6) AS span_y, max(x) - min(x) < 0.05 AND max(y) - min(y) < 0.05 AS tiny FROM (SELECT areaId, x, p.y AS y FROM " + _UNWRAPPED.format(keys="areaId, polygon, ring_no", points="(SELECT * FROM " + _AREA_POINTS + " WHERE polygon = 1 AND ring_no = 1)") + ") GROUP BY areaId")
def g17(spark, d):
    """Width and height of an area's first ring, and whether it is too small to be drawn as a shape."""
    b = geo.span(F.col("ring"))
    tiny = (b["x"] < 0.05) & (b["y"] < 0.05)
    return _rings(areas(spark, d)).where("polygon = 1 AND ring_no = 1").select("areaId", F.round(b["x"], 6).alias("span_x"), F.round(b["y"], 6).alias("span_y"), tiny.alias("tiny"))


_PARTS = "(SELECT areaId, polygon, min(x) AS low, max(x) AS high FROM " + _UNWRAPPED.format(keys="areaId, polygon, ring_no", points="(SELECT * FROM " + _AREA_POINTS + " WHERE ring_no = 1)") + " GROUP BY ALL)"


@query("g8_antimeridian", f"SELECT areaId, count(*)::INT AS polygons, round(min(a), 9) AS min_x, round(max(b), 9) AS max_x FROM (SELECT areaId, CASE WHEN low >= -180 AND high <= 180 THEN low ELSE greatest(low, -180 + 360 * k) - 360 * k END AS a, CASE WHEN low >= -180 AND high <= 180 THEN high ELSE least(high, 180 + 360 * k) - 360 * k END AS b FROM (SELECT *, unnest(CASE WHEN low >= -180 AND high <= 180 THEN [0] ELSE range(floor((low + 180) / 360)::BIGINT, floor((high + 180) / 360)::BIGINT + 1) END) AS k FROM {_PARTS})) GROUP BY areaId")
def g8(spark, d):
    s = areas(spark, d).where("geometry IS NOT NULL").select("areaId", geo.split_at_antimeridian("geometry").alias("g"))
    b = geo.bounds(F.col("g"))
    return s.select("areaId", F.size("g").alias("polygons"), F.round(b["min_x"], 9).alias("min_x"), F.round(b["max_x"], 9).alias("max_x"))


@query("g13_canonical", f"SELECT areaId, true AS same, false AS moved_same FROM {_SHAPES}")
def g13(spark, d):
    """The text of a geometry is that of its rings turned round and begun elsewhere, polygons the other way; not that of one moved."""
    turn = lambda r: F.concat(F.slice(F.reverse(r), 2, 1 << 30), F.slice(F.reverse(r), 2, 1))
    turned = F.reverse(F.transform("geometry", lambda p: F.transform(p, turn)))
    moved = F.transform("geometry", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q["x"].alias("x"), (q["y"] / 2).alias("y")))))
    a = areas(spark, d).where("geometry IS NOT NULL").select("areaId", geo.canonical("geometry").alias("c"), geo.canonical(turned).alias("t"), geo.canonical(moved).alias("m"))
    return a.select("areaId", (F.col("c") == F.col("t")).alias("same"), (F.col("c") == F.col("m")).alias("moved_same"))


#: printf rounds by the exact value; only sixteenths lie half way between two outputs, and go away from zero.
_FIXED = "printf('%.3f', CASE WHEN {v} * 16 = floor({v} * 16) AND ({v} * 16)::BIGINT % 2 <> 0 THEN {v} + sign({v}) * 0.0001 ELSE {v} + 0.0 END)"
_PATH = f"array_to_string(list_transform(flatten(geometry), lambda r: 'M' || array_to_string(list_transform(r, lambda p: {_FIXED.format(v='p.x')} || ' ' || {_FIXED.format(v='p.y')}), 'L') || 'Z'), '')"


@query("k17_g14_svg_path", f"SELECT 'candidate' AS kind, id AS key, {_PATH} AS path FROM {CAND} WHERE geometry IS NOT NULL UNION ALL SELECT 'area', areaId, {_PATH} FROM {_SHAPES}")
def g14_all(spark, d):
    path = geo.svg_path(F.col("geometry")).alias("path")
    c, a = candidates(spark, d).where("geometry IS NOT NULL"), areas(spark, d).where("geometry IS NOT NULL")
    return c.select(F.lit("candidate").alias("kind"), F.col("id").alias("key"), path).unionByName(a.select(F.lit("area").alias("kind"), F.col("areaId").alias("key"), path))


@query("g15_wound_rings", "SELECT areaId, polygon, ring_no, round(CASE WHEN ring_no = 1 THEN abs(area) ELSE -abs(area) END, 6) + 0.0 AS area, ring[1].x AS first_x, ring[1].y AS first_y, CASE WHEN kept THEN ring[2].x ELSE ring[-2].x END AS second_x, CASE WHEN kept THEN ring[2].y ELSE ring[-2].y END AS second_y FROM (SELECT *, (area > 0) = (ring_no = 1) AS kept FROM " + _AREA_RINGS + " JOIN " + _AREAS.format(keys="areaId, polygon, ring_no", points=_AREA_POINTS) + " USING (areaId, polygon, ring_no))")
def g15_rings(spark, d):
    """Signed area and first two points of every ring as wound."""
    w = areas(spark, d).where("geometry IS NOT NULL").select("areaId", F.posexplode(geo.wound(F.col("geometry"))).alias("polygon", "rings"))
    r = w.select("areaId", (F.col("polygon") + 1).alias("polygon"), F.posexplode("rings").alias("ring_no", "ring"))
    at = lambda i, axis: F.col("ring")[i][axis]
    return r.select(
        "areaId", "polygon", (F.col("ring_no") + 1).alias("ring_no"), (F.round(geo.ring_area(F.col("ring")), 6) + F.lit(0.0)).alias("area"),
        at(0, "x").alias("first_x"), at(0, "y").alias("first_y"), at(1, "x").alias("second_x"), at(1, "y").alias("second_y"),
    )


@query("r8_rotated_rings", f"SELECT areaId, polygon, ring_no, list_position(xs, list_min(xs)) AS at, array_to_string(list_transform(list_concat(xs[list_position(xs, list_min(xs)):], xs[:list_position(xs, list_min(xs)) - 1]), lambda x: printf('%.6f', x)), ' ') AS rotated FROM (SELECT areaId, polygon, ring_no, list_transform(ring[:-2], lambda p: p.x) xs FROM {_AREA_RINGS})")
def r8_all(spark, d):
    a = areas(spark, d).where("geometry IS NOT NULL").select("areaId", F.posexplode("geometry").alias("polygon", "rings"))
    r = a.select("areaId", (F.col("polygon") + 1).alias("polygon"), F.posexplode("rings").alias("ring_no", "ring"))
    xs = F.transform(F.slice("ring", F.lit(1), F.size("ring") - 1), lambda p: p["x"])
    r = r.select("areaId", "polygon", (F.col("ring_no") + 1).alias("ring_no"), xs.alias("xs")).withColumn("at", F.array_position("xs", F.array_min("xs")))
    turned = F.concat(F.slice("xs", F.col("at"), F.size("xs")), F.slice("xs", F.lit(1), F.col("at") - 1))
    return r.select("areaId", "polygon", "ring_no", "at", F.array_join(F.transform(turned, lambda x: F.format_string("%.6f", x)), " ").alias("rotated"))


@query("g18_simplified", f"SELECT areaId, true AS fewer, true AS closed, true AS kept_ends FROM {_SHAPES}")
def g18(spark, d):
    """On the projected plane: no ring grows, stays open or falls below four points; tests compare which points stay."""
    a = areas(spark, d).where("geometry IS NOT NULL").select("areaId", "geometry", geo.simplified(5e-6, projected=True)("geometry").alias("g"))
    rings = F.flatten("g")
    ends = F.forall(rings, lambda r: (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"]))
    return a.select("areaId", (geo.vertices(F.col("g")) <= geo.vertices(F.col("geometry"))).alias("fewer"), ends.alias("closed"), F.forall(rings, lambda r: F.size(r) >= 4).alias("kept_ends"))


@query("g19_presimplified", f"SELECT areaId, true AS fewer, true AS closed FROM {_SHAPES}")
def g19(spark, d):
    a = areas(spark, d).where("geometry IS NOT NULL").select("areaId", "geometry", geo.presimplified(1e-5)("geometry").alias("g"))
    closed = F.forall(F.flatten("g"), lambda r: (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.size(r) >= 4))
    return a.select("areaId", (geo.vertices(F.col("g")) <= geo.vertices(F.col("geometry"))).alias("fewer"), closed.alias("closed"))


@query("g20_s10_arcs", "SELECT areaId AS id, row_number() OVER (PARTITION BY areaId ORDER BY polygon, ring_no)::INT AS ring_no, len(ring)::INT AS points, round(list_sum(list_transform(ring, lambda p, i: p.x * i)), 2) AS sum_x, round(list_sum(list_transform(ring, lambda p, i: p.y * i)), 2) AS sum_y FROM " + _AREA_RINGS)
def g20(spark, d):
    """Areas as packages of delta arcs on a grid, every other arc stored backwards, decoded by topology()."""
    rings = F.flatten("geometry")
    arcs = F.transform(rings, lambda r, i: F.transform(geo.quantised(F.when(i % 2 == 1, F.reverse(r)).otherwise(r), 1e6), lambda p: F.array(p["x"], p["y"])))
    refs = F.array(F.transform(rings, lambda r, i: F.array(F.when(i % 2 == 1, -i - 1).otherwise(i))))
    feature = F.struct(F.col("areaId").alias("id"), F.lit("Polygon").alias("type"), refs.alias("arcs"))
    package = F.struct(
        F.struct(F.array(F.lit(1e-6), F.lit(1e-6)).alias("scale"), F.array(F.lit(0.0), F.lit(0.0)).alias("translate")).alias("transform"), arcs.alias("arcs"),
        F.create_map(F.lit("areas"), F.struct(F.array(feature).alias("geometries"))).alias("objects"),
    )
    packed = areas(spark, d).where("geometry IS NOT NULL").select(F.to_json(package).alias("package"))
    r = readers.topology(packed).select("id", F.posexplode("rings").alias("ring_no", "ring"))
    total = lambda axis: F.round(F.aggregate(F.transform("ring", lambda p, i: p[axis] * (i + 1)), F.lit(0.0), lambda s, v: s + v), 2)
    return r.select("id", (F.col("ring_no") + 1).alias("ring_no"), F.size("ring").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


_TURN = "CASE WHEN abs(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax})) < 1e-12 THEN 0 ELSE sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax})) END"


def _turn(a, b, p):
    return _TURN.format(ax=a[0], ay=a[1], bx=b[0], by=b[1], px=p[0], py=p[1])


_A, _B, _C, _D = ("e.x", "e.y"), ("e.x2", "e.y2"), ("(f.x + k.s)", "f.y"), ("(f.x2 + k.s)", "f.y2")
_OVERLAPS = f"""
WITH v AS (SELECT areaId, polygon, ring_no, no, x, p.y AS y FROM {_UNWRAPPED.format(keys="areaId, polygon, ring_no", points=_AREA_POINTS)}),
m AS (SELECT areaId, polygon, ring_no, (min(x) + max(x)) / 2 AS mid FROM v GROUP BY ALL),
u AS (SELECT v.areaId, v.polygon, v.ring_no, no, x - 360 * round((m.mid - o.mid) / 360) AS x, y FROM v JOIN m USING (areaId, polygon, ring_no) JOIN m o ON o.areaId = v.areaId AND o.polygon = v.polygon AND o.ring_no = 1),
g AS (SELECT areaId, polygon, ring_no, no, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM u WINDOW w AS (PARTITION BY areaId, polygon, ring_no ORDER BY no)),
e AS (SELECT * FROM g WHERE x2 IS NOT NULL),
b AS (SELECT areaId, polygon, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM u WHERE ring_no = 1 GROUP BY ALL),
k AS (SELECT a.areaId AS ka, a.polygon AS pa, c.areaId AS kb, c.polygon AS pb, s FROM b a JOIN b c ON a.areaId < c.areaId CROSS JOIN (VALUES (-360), (0), (360)) t(s) WHERE a.x0 < c.x1 + s AND c.x0 + s < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1),
crossing AS (SELECT DISTINCT ka, kb FROM k JOIN e ON e.areaId = k.ka AND e.polygon = k.pa JOIN e f ON f.areaId = k.kb AND f.polygon = k.pb
  WHERE ({_turn(_A, _B, _C)}) * ({_turn(_A, _B, _D)}) < 0 AND ({_turn(_C, _D, _A)}) * ({_turn(_C, _D, _B)}) < 0),
sides AS (SELECT ka, pa, kb, pb, s FROM k UNION ALL SELECT kb, pb, ka, pa, -s FROM k),
q AS (SELECT sides.*, e.no, e.x AS px, e.y AS py FROM sides JOIN e ON e.areaId = ka AND e.polygon = pa AND e.ring_no = 1),
r AS (SELECT ka, kb, pa, pb, s, q.no, f.ring_no, count(*) FILTER ((f.y > py) <> (f.y2 > py) AND px < f.x + s + (py - f.y) * (f.x2 - f.x) / (f.y2 - f.y)) % 2 = 1 AS odd,
  bool_or({_turn(("(f.x + s)", "f.y"), ("(f.x2 + s)", "f.y2"), ("px", "py"))} = 0 AND px BETWEEN least(f.x, f.x2) + s AND greatest(f.x, f.x2) + s AND py BETWEEN least(f.y, f.y2) AND greatest(f.y, f.y2)) AS edge
  FROM q JOIN e f ON f.areaId = kb AND f.polygon = pb GROUP BY ALL),
inside AS (SELECT least(ka, kb) AS ka, greatest(ka, kb) AS kb FROM r GROUP BY ka, kb, pa, pb, s, no HAVING bool_or(ring_no = 1 AND odd AND NOT edge) AND NOT bool_or(ring_no > 1 AND (odd OR edge)))
SELECT ka AS a, kb AS b FROM crossing UNION SELECT ka, kb FROM inside
"""


@query("j13_g12_overlaps", _OVERLAPS)
def j13(spark, d):
    return regions.overlaps(areas(spark, d))


@query("j18_unexplained", f"SELECT a, b FROM ({_OVERLAPS}) WHERE (length(a) + length(b)) % 2 = 1")
def j18(spark, d):
    """Overlaps without an exception; exceptions name some pairs the other way round."""
    pairs = regions.overlaps(areas(spark, d))
    return regions.unexplained(pairs, pairs.where((F.length("a") + F.length("b")) % 2 == 0).select(F.col("b").alias("a"), F.col("a").alias("b")))


def _features(spark, d):
    a = table(spark, d, "city_area")
    return a.select(F.col("sourceId").alias("divisionId"), "sourceId", "areaId", "countryCode", F.col("countryCode").alias("owner"), "nameLocal", "geometry")


@query("v1_check")
def v1(spark, d):
    """All codes of all countries: repeated rows of the table are duplicate divisions, the last release is the index."""
    f = _features(spark, d)
    expected = table(spark, d, "country_info").select("countryCode", F.lit("range").alias("kind"), F.lit(None).cast("int").alias("value"), F.lit(1).alias("minimum"), F.lit(500).alias("maximum"))
    exceptions = spark.createDataFrame([("e1", "overlap", "x", "y")], "id string, kind string, a string, b string")
    sizes = table(spark, d, "country_manifest").where(F.col("boundaryRelease") == LATEST).groupBy("countryCode").agg(F.max("byteSize").alias("bytes"))
    return regions.audit(f, expected, release(spark, d, LATEST).select("countryCode", "areaId"), exceptions, sizes)


_NAMELESS = "coalesce(regexp_replace(nameLocal, '\\A[\\s\\p{Z}]+|[\\s\\p{Z}]+\\z', '', 'g'), '') = ''"


@query("v1_feature_codes", f"SELECT countryCode, code, sourceId AS subject, count(*) AS n FROM (SELECT countryCode, sourceId, unnest(list_filter([CASE WHEN areaId <> countryCode || ':overture:' || sourceId THEN 'IDENTITY_MISMATCH' END, CASE WHEN {_NAMELESS} THEN 'LOCAL_NAME_MISSING' END, CASE WHEN geometry IS NULL THEN 'GEOMETRY_TYPE_INVALID' END], lambda c: c IS NOT NULL)) AS code FROM city_area UNION ALL SELECT countryCode, sourceId, 'DIVISION_ID_DUPLICATE' FROM city_area GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL")
def v1_features(spark, d):
    return regions.feature_codes(_features(spark, d)).groupBy("countryCode", "code", "subject").agg(F.count("*").alias("n"))


@query("v1_index_codes", f"SELECT DISTINCT countryCode, 'INDEX_ID_MISMATCH' AS code FROM (SELECT coalesce(a.countryCode, b.countryCode) AS countryCode FROM (SELECT countryCode, areaId, count(*) n FROM city_area GROUP BY ALL) a FULL JOIN (SELECT countryCode, areaId FROM area_snapshot WHERE boundaryRelease = '{LATEST}' QUALIFY row_number() OVER (PARTITION BY areaId ORDER BY loadedAt DESC) = 1) b ON a.areaId = b.areaId AND a.countryCode = b.countryCode WHERE a.areaId IS NULL OR b.areaId IS NULL OR a.n > 1)")
def v1_index(spark, d):
    return regions.index_codes(_features(spark, d), release(spark, d, LATEST).select("countryCode", "areaId")).drop("subject")


@query("v1_metrics", "SELECT countryCode, count(*) AS features, coalesce(sum(n), 0)::BIGINT AS vertices, coalesce(max(n), 0)::INT AS most, coalesce(list_sort(list(n))[ceil(count(n) * 0.5)::INT], 0)::INT AS p50, coalesce(list_sort(list(n))[ceil(count(n) * 0.95)::INT], 0)::INT AS p95 FROM (SELECT countryCode, len(flatten(flatten(geometry))) AS n FROM city_area) GROUP BY countryCode")
def v1_metrics(spark, d):
    sizes = table(spark, d, "country_manifest").where(F.col("boundaryRelease") == LATEST).groupBy("countryCode").agg(F.max("byteSize").alias("bytes"))
    return regions.metrics(_features(spark, d), sizes).select("countryCode", "features", "vertices", F.col("most").cast("int"), F.col("p50").cast("int"), F.col("p95").cast("int"))


@query("v2_count_expectation", "SELECT countryCode, CASE ascii(countryCode[2]) % 4 WHEN 0 THEN CASE WHEN n NOT BETWEEN 5 AND 40 THEN 'COUNT_MISMATCH' END WHEN 1 THEN CASE WHEN n <> 12 THEN 'COUNT_MISMATCH' END WHEN 2 THEN 'COUNT_MISMATCH' ELSE 'COUNT_REFERENCE_INVALID' END AS code FROM (SELECT countryCode, count(*) AS n FROM city_area GROUP BY countryCode) WHERE code IS NOT NULL")
def v2(spark, d):
    """Expectations of all kinds by country: a range, an exact count, bounds the wrong way round, none."""
    kind = F.ascii(F.substring("countryCode", 2, 1)) % 4
    counts = table(spark, d, "city_area").groupBy("countryCode").agg(F.count("*").alias("n")).select(
        "countryCode", "n", F.when(kind == 0, "range").when(kind == 1, "exact").alias("kind"), F.lit(12).alias("value"),
        F.when(kind == 0, 5).when(kind == 2, 40).alias("minimum"), F.when(kind == 0, 40).when(kind == 2, 5).alias("maximum"),
    )
    return regions.count_codes(counts)


@query("v15_budgets", f"SELECT packageId, count(*) AS features, coalesce(sum(len(flatten(flatten(geometry)))), 0)::BIGINT AS vertices, coalesce(sum(len(flatten(flatten(geometry)))), 0) <= 1000000 AND max(len(aliases)) <= 20 AS within FROM {AREA} GROUP BY packageId")
def v15(spark, d):
    v = F.coalesce(F.sum(F.when(F.col("geometry").isNotNull(), geo.vertices(F.col("geometry")))), F.lit(0)).cast("bigint")
    return areas(spark, d).groupBy("packageId").agg(F.count("*").alias("features"), v.alias("vertices"), ((v <= 1_000_000) & (F.max(F.size("aliases")) <= 20)).alias("within"))
