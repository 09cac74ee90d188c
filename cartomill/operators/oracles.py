"""DuckDB SQL for the core's queries on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["p2_found"] = """
WITH rel AS (SELECT boundaryRelease r, dense_rank() OVER (ORDER BY split_part(boundaryRelease, '.', 1), try_cast(split_part(boundaryRelease, '.', 2) AS bigint)) p
             FROM (SELECT DISTINCT boundaryRelease FROM area_snapshot)),
prel AS (SELECT boundaryRelease r, dense_rank() OVER (ORDER BY split_part(boundaryRelease, '.', 1), try_cast(split_part(boundaryRelease, '.', 2) AS bigint)) p
             FROM (SELECT DISTINCT boundaryRelease FROM country_manifest)),
a AS (SELECT areaId k, p, {'a': adminLevel, 'b': nameZh, 'c': nameLocal, 'd': list_sort(list_distinct(aliases)), 'e': geometryHash, 'f': round(centroid.x, 6), 'g': round(centroid.y, 6)}::VARCHAR v
      FROM area_snapshot JOIN rel ON r = boundaryRelease
      QUALIFY row_number() OVER (PARTITION BY areaId, boundaryRelease ORDER BY loadedAt DESC) = 1),
b AS (SELECT packageId k, p, {'a': boundaryVersion, 'b': featureCount}::VARCHAR v
      FROM country_manifest JOIN prel ON r = boundaryRelease
      QUALIFY row_number() OVER (PARTITION BY packageId, boundaryRelease ORDER BY loadedAt DESC) = 1),
da AS (SELECT coalesce(n.p, o.p + 1) p, coalesce(n.k, o.k) k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END c
       FROM a n FULL JOIN a o ON n.k = o.k AND n.p = o.p + 1 WHERE n.v IS DISTINCT FROM o.v),
db AS (SELECT coalesce(n.p, o.p + 1) p, coalesce(n.k, o.k) k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END c
       FROM b n FULL JOIN b o ON n.k = o.k AND n.p = o.p + 1 WHERE n.v IS DISTINCT FROM o.v)
SELECT r AS boundary_release, 'area' AS record_kind, k AS record_key, c AS change_kind FROM da JOIN rel USING (p) WHERE p > 1
UNION ALL
SELECT r, 'package', k, c FROM db JOIN prel USING (p) WHERE p > 1
"""

_RECORDS = r"""
WITH t AS (SELECT record_no, feed, CASE WHEN right(record, 1) = chr(13) THEN left(record, len(record) - 1) ELSE record END x FROM city_raw),
u AS (SELECT *, regexp_replace(x, '"([^"]|"")*"', '', 'g') bare,
        feed = 'compact' AND NOT regexp_full_match(x, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS q
      FROM t WHERE x <> ''),
v AS (SELECT *, CASE feed WHEN 'cities500' THEN len(string_split(x, chr(9))) = 19 ELSE len(string_split(bare, ',')) = 11 END AS right_count,
        CASE feed WHEN 'cities500' THEN string_split(x, chr(9)) ELSE list_transform(regexp_extract_all(',' || x, ',("([^"]|"")*"|[^,]*)', 1), lambda f: CASE WHEN f[1] = '"' AND f[-1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) END AS f
      FROM u),
w AS (SELECT *, f[1] id, CASE feed WHEN 'cities500' THEN f[9] ELSE f[5] END cc, coalesce(CASE feed WHEN 'cities500' THEN f[15] ELSE f[11] END, '') pop FROM v),
z AS (SELECT *, CASE WHEN q THEN 'quoting' WHEN NOT right_count THEN 'column_count'
        WHEN NOT (regexp_full_match(id, '[0-9]+') AND coalesce(try_cast(id AS hugeint) <= 9007199254740991, false)) THEN 'id'
        WHEN cc NOT IN (SELECT countryCode FROM country_info) THEN 'country_code'
        WHEN pop <> '' AND NOT (regexp_full_match(pop, '[0-9]+') AND coalesce(try_cast(pop AS hugeint) <= 9007199254740991, false)) THEN 'population' END reason FROM w)
"""
ORACLES["p4_found"] = _RECORDS + "SELECT record_no, reason FROM z WHERE reason IS NOT NULL"
ORACLES["p4_loaded"] = _RECORDS + """
SELECT record_no, id::BIGINT AS id, nullif(f[2], '') AS name, nullif(f[3], '') AS asciiName, string_split(nullif(f[4], ''), ',') AS aliases, cc AS countryCode,
       CASE feed WHEN 'compact' THEN nullif(f[6], '') END AS continentCode, try_cast(CASE feed WHEN 'compact' THEN f[7] ELSE f[5] END AS double) AS lat,
       try_cast(CASE feed WHEN 'compact' THEN f[8] ELSE f[6] END AS double) AS lon, CASE feed WHEN 'compact' THEN nullif(f[9], '') END AS zhName,
       nullif(CASE feed WHEN 'compact' THEN f[10] ELSE f[11] END, '') AS admin1, nullif(pop, '')::BIGINT AS population
FROM z WHERE reason IS NULL
"""
