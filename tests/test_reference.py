"""Facts about the reference's operators on small literal inputs."""

import decimal
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators import gazetteer, regions, relational, selector, visits
from cartomill.plans import function_queries, io_queries
from cartomill.sources import readers, writers
from cartomill.streaming import merge

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQ = lambda x, y, s=1.0: [[[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}, {"x": x, "y": y}]]]


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def shapes(spark, rows):
    return spark.createDataFrame([(k, "n", g) for k, g in rows], f"areaId string, nameLocal string, geometry {geo.GEOM}")


def division(spark, *rows):
    base = {"id": "included", "src": "AA", "sub": "locality", "lvl": 6, "loc": "city", "land": True}
    return spark.createDataFrame(
        [tuple((base | r).values()) for r in rows], "divisionId string, sourceCountryCode string, subtype string, adminLevel int, localType string, isLand boolean"
    )


RULES = dict(owners=("AA", "AB"), subtypes=("locality",), levels=(6,), local_types=(("city",),))


def picked(df, **more):
    return sorted(r.divisionId for r in selector.select(df, selector.Selector(**(RULES | more))).collect())


def test_selector(spark):
    df = division(spark, {}, {"id": "s", "sub": "x"}, {"id": "l", "lvl": 7}, {"id": "t", "loc": "village"}, {"id": "n", "loc": None})
    assert picked(df) == ["included"]
    df = division(spark, {"id": "aa"}, {"id": "ab", "src": "ab"}, {"id": "zz", "src": "ZZ"}, {"id": "null", "src": None})
    assert picked(df) == ["aa", "ab"]
    df = division(spark, {"id": "allow", "sub": "x"}, {"id": "both", "sub": "x"}, {"id": "deny"}, {"id": "foreign", "src": "ZZ"}, {"id": "water", "land": False})
    assert picked(df, allow=("allow", "both", "foreign", "water"), deny=("both", "deny")) == ["allow"]
    with pytest.raises(Exception, match="duplicate divisionId: same"):
        picked(division(spark, {"id": "same"}, {"id": "same", "sub": "x"}))
    with pytest.raises(ValueError):
        selector.Selector(owners=("AA",))


def city(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string, asciiName string, aliases array<string>, countryCode string, lat double, lon double, zhName string, population bigint")


CITIES = [
    (1, "München", "Munchen", ["Muenchen"], "DE", 48.1, 11.5, "慕尼黑", 10),
    (2, "São Paulo", "Sao Paulo", None, "BR", -23.5, -46.6, None, 20),
    (3, "Springfield", "Springfield", None, "US", 37.2, -93.3, None, 160),
    (4, "Springfield", "Springfield", None, "US", 39.8, -89.6, None, 110),
    (9000001, "East", "East", None, "FJ", 0.0, 179.9, None, None),
    (9000002, "West", "West", None, "FJ", 0.0, -179.99, None, None),
]


def test_search_and_nearest(spark):
    c = city(spark, CITIES)
    ids = lambda q, k=5: [r.id for r in gazetteer.search_cities(c, q, k).collect()]
    assert ids("慕尼黑") == [1] and ids("sao paulo") == [2] and ids("SÃO--paulo") == [2] and ids("  ") == []
    assert ids("Springfield") == [3, 4] and ids("Springfield", 1) == [3] and ids("Springfield", 0) == [] and ids("x", math.nan) == []
    near = lambda lon, lat, k: [r.id for r in gazetteer.nearest(c, lon, lat, k).collect()]
    assert near(179.9, 0, 1) == [9000001] and near(-179.99, 0, 1) == [9000002] and near(0, 100, 3) == [] and near(0, 0, 0) == []


def test_area_search(spark):
    rows = [("a", "北京", "Beijing", ["Peking"]), ("q", None, "Québec Ex", None), ("f2", None, "Other", ["Fairfax"]), ("f1", None, "Fairfax", None)]
    a = spark.createDataFrame(rows, "areaId string, nameZh string, nameLocal string, aliases array<string>")
    ids = lambda q, k=9: [r.areaId for r in gazetteer.search_areas(a, q, k).collect()]
    assert ids("Beijing") == ids("peking") == ids("北京") == ["a"] and ids("QUEBEC EX") == ids("bec ex") == ["q"]
    first = gazetteer.search_areas(a, "quebec ex", 9).collect()[0]
    assert (first.match_rank, first.field_rank) == (0, 0)  # without a Chinese name the local one is the first field
    both = a.withColumn("kind", F.when(F.col("areaId") == "f2", "country").otherwise("area"))
    assert [r.areaId for r in gazetteer.search_areas(both, "Fairfax", 9).collect()] == ["f2", "f1"]
    zh = spark.createDataFrame([("1", "上海区"), ("2", "北京区"), ("3", "阿区")], "areaId string, nameZh string").withColumn("nameLocal", F.lit("x")).withColumn("aliases", F.array().cast("array<string>"))
    assert [r.areaId for r in gazetteer.search_areas(zh, "区", 9).collect()] == ["3", "2", "1"]
    assert ids("Fairfax") == ["f1", "f2"] and ids("") == ids("x" * 161) == ids("Fairfax", 0) == []


def test_candidate_ranking(spark):
    c = city(spark, CITIES[:1])
    k = spark.createDataFrame(
        [("1", "Munich", "Munich, Bayern", "de", "city", 0.9), ("2", "慕尼黑", "慕尼黑, 巴伐利亚", "DE", "city", 0.1), ("3", "München", "x", "AT", "city", 0.9), ("4", None, "Dorf, München", "DE", None, None)],
        "id string, name string, displayName string, countryCode string, type string, importance double",
    )
    got = [(r.candidate_id, r.score) for r in gazetteer.rank_candidates(c, k).orderBy("position").collect()]
    assert got == [("2", 1060.1), ("4", 540.0)]
    m = spark.createDataFrame([("5", "munchen", " x ,  MÜNCHEN ", "de", "municipality", 0.5)], k.schema)
    assert [(r.candidate_id, r.score) for r in gazetteer.rank_candidates(c, m).collect()] == [("5", 1050.5)]
    tied = k.where("id = '2'").select(F.lit("9").alias("id"), *k.columns[1:]).unionByName(k.where("id = '2'")).withColumn("n", F.when(F.col("id") == "9", 1).otherwise(2))
    assert [r.candidate_id for r in gazetteer.rank_candidates(c, tied, order="n").orderBy("position").collect()] == ["9", "2"]


def test_kept_aliases(spark):
    r = spark.createDataFrame([(["a", " a ", "b", "", "n", "z", "c", "d", None], "n", "m", "p", ["z", "p", "n", "y", "y"])], "al array<string>, name string, ascii string, zh string, zhs array<string>")
    kept = gazetteer.kept_aliases(*[F.col(c) for c in ("al", "name", "ascii", "zh", "zhs")])
    own = gazetteer.source_aliases(*[F.col(c) for c in ("al", "name", "ascii", "zhs")])
    assert r.select(kept.alias("k"), own.alias("o")).collect()[0] == (["a", "b", "c", "z", "y"], ["a", "b", "c", "d"])


def test_build_of_cities_refuses(spark):
    rows = spark.createDataFrame([(1, "n", "n", ["x"], 1.0, 2.0, "AA", "", 5)], "id bigint, name string, asciiName string, aliases array<string>, lat double, lon double, countryCode string, admin1 string, population bigint")
    info = spark.createDataFrame([("AA", "EU")], "countryCode string, continentCode string")
    names = spark.createDataFrame([(1, "恩", ["恩二"])], "cityId bigint, preferred string, aliases array<string>")
    got = gazetteer.build_cities(rows, info, names).collect()[0]
    assert (got.zhName, got.aliases, got.admin1, got.truncated) == ("恩", ["x", "恩二"], None, False)
    for change, says in (({"lat": 91.0}, "invalid required value"), ({"countryCode": "ZZ"}, "unknown country"), ({"name": ""}, "invalid required value")):
        bad = rows.withColumns({k: F.lit(v) for k, v in change.items()})
        with pytest.raises(Exception, match=says):
            gazetteer.build_cities(bad, info, names).collect()
        assert gazetteer.refused_cities(bad, info).count() == 1
    with pytest.raises(Exception, match="duplicate id"):
        gazetteer.build_cities(rows.unionByName(rows), info, names).collect()


def test_candidate_keys_keep_vowel_signs(spark):
    assert one(spark, text.candidate_key(F.lit(" दिल्ली\u3000")).alias("a"), text.candidate_key(F.lit("MÜNCHEN")).alias("b")) == ("दिल्ली", "munchen")


def test_names_of_a_city(spark):
    n = spark.createDataFrame([(1, "zh", "穆尼黑", False), (1, "zh-CN", "慕尼黑", True), (1, "de", "x", True), (1, "zh", None, True), (1, "zh", "穆尼黑", False)], "cityId bigint, language string, name string, is_preferred boolean")
    assert [tuple(r) for r in gazetteer.preferred_names(n).collect()] == [(1, "慕尼黑", ["穆尼黑"])]


def test_last_writer_wins_is_strict(spark):
    s = "k string, t int, v string"
    cur = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), ("c", 5, "old")], s)
    inc = spark.createDataFrame([("a", 2, "new"), ("b", 5, "new"), ("d", None, "new"), ("c", 4, "new")], s)
    got = dict((r.k, r.v) for r in relational.last_writer_wins(cur, inc, ["k"], "t").collect())
    assert got == {"a": "new", "b": "old", "c": "old", "d": "new"}
    assert {r.k for r in relational.last_writer_wins(cur, inc, ["k"], "t", replace=True).collect()} == {"a", "b", "c", "d"}


def test_set_operators(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", None), (None, 1)], "k string, v int"), spark.createDataFrame([("y", None), ("z", 1), ("z", 1)], "k string, v int")
    assert sorted(map(tuple, relational.set_difference(a, b, "k").collect())) == [("x", "missing"), ("z", "extra")]
    assert relational.mismatches(a, b, "k", ["v"]).collect() == []
    assert [tuple(r) for r in relational.duplicates(b, "k").collect()] == [("z", 2)]
    assert sorted(r.k for r in relational.replace_part(a, b, "k", "x").where("k IS NOT NULL").collect()) == ["y", "y", "z", "z"]


def test_statistics(spark):
    v = spark.createDataFrame([(1, "CN", "AS", 1), (2, "CN", "AS", 2), (3, "FR", "EU", 3), (1, "XX", "OC", 4)], "cityId bigint, countryCode string, continentCode string, ordinal int")
    assert tuple(visits.stats(v).collect()[0]) == (3, 2, {"AS": 2, "EU": 1})
    assert tuple(visits.stats(v.limit(0)).collect()[0]) == (0, 0, {})


def test_consolidation(spark):
    s = "areaId string, cityId bigint, label string, createdAt string, updatedAt string, visitedOn string, datePrecision string, areaSnapshot string, note string"
    row = lambda area, k, label, created, updated, day, note, how="year": (area, k, label, created, updated, day, how, f"{area}{k}", note)
    v = spark.createDataFrame(
        [
            row("one", 1, "A", "2020", "2021", "2021", "n" * 600, None),
            row("two", 1, "A", "2020", "2021", "2021", "first"), row("two", 2, "B", "2019", "2024", "2020-08-03", "second", "day"), row("two", 3, "C", "2019", "2022", "1999", "", None),
            row("long", 1, "A", "2020", "2021", "2021", "n" * 300), row("long", 2, "B", "2019", "2024", "2020", "m" * 300), row("long", 3, "C", "2018", "2023", "2019", "s"),
            row("none", 1, "A", "2020", "2021", "2021", "n" * 500), row("none", 2, "B", "2019", "2024", "2020", "m" * 500), row("void", 1, "A", "1", "1", "1", None), row("void", 2, "B", "2", "2", "2", ""),
        ],
        s,
    )
    got = {r.areaId: r for r in visits.consolidate(v).collect()}
    left = sorted((r.areaId, r.cityId) for r in visits.overflow(v).collect())
    assert left == [("long", 2), ("none", 2)]
    assert got["one"].note == "n" * 600 and (got["one"].visitedOn, got["one"].datePrecision) == ("2021", None)
    two = got["two"]
    assert two.note == "A：first\nB：second" and (two.createdAt, two.updatedAt, two.visitedOn, two.datePrecision, two.newest_city, two.areaSnapshot) == ("2019", "2024", "2020-08-03", "day", 2, "two2")
    assert got["long"].note == "A：" + "n" * 300 + "\nC：s" and (got["long"].updatedAt, got["long"].areaSnapshot, got["long"].visitedOn) == ("2023", "long3", "2019")
    assert got["none"].note == "n" * 500 and got["none"].newest_city == 1 and got["void"].note == ""
    plain = v.drop("visitedOn", "datePrecision", "areaSnapshot").withColumn("line", F.lit("clash")).withColumn("n", F.lit(1))
    assert {r.areaId: r.note for r in visits.consolidate(plain).collect()} == {k: r.note for k, r in got.items()}
    assert visits.consolidate(v.limit(0)).collect() == [] and visits.overflow(v.limit(0)).collect() == []


def test_consolidation_of_a_large_area_collects_few_lines(spark):
    """A thousand notes of one area: the greedy fold over all of them is matched from the few lines that can fit."""
    rng = random.Random(3)
    rows = [("a", k, "L", "2020", f"2021-{k:05}", rng.choice(["x", "yy", "z" * rng.randrange(1, 90)])) for k in range(1000)]
    note, kept = "", []
    for _, k, label, _, _, text_ in rows:
        joined = f"{note}\n{label}：{text_}" if note else f"{label}：{text_}"
        if len(joined) <= 500:
            note, kept = joined, [*kept, k]
    v = spark.createDataFrame(rows, "areaId string, cityId bigint, label string, createdAt string, updatedAt string, note string")
    assert visits.consolidate(v).collect()[0].note == note
    assert sorted(r.cityId for r in visits.kept_visits(v).collect()) == kept and visits.overflow(v).count() == 1000 - len(kept)


def test_geometry_columns(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    r = one(
        spark, geo.ring_area(ring((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))).alias("a"), geo.wrapped(F.lit(540.0)).alias("w"),
        geo.unwrapped(ring((170, 0), (-170, 0), (170, 1))).alias("u"), geo.mercator_y(F.lit(90.0)).alias("top"), geo.ring_area(F.array().cast(geo.RING)).alias("none"),
        geo.mercator_lat(geo.mercator_y(F.lit(39.9042))).alias("back"),
    )
    assert r.a == 2 and r.w == -180 and [p.x for p in r.u] == [170, 190, 170] and abs(r.top) < 1e-8 and r.none == 0 and abs(r.back - 39.9042) < 1e-8
    line = [[[{"x": x, "y": y} for x, y in ((170.0, 0.0), (-170.0, 0.0), (-170.0, 5.0), (170.0, 5.0), (170.0, 0.0))]]]
    df = shapes(spark, [("line", line), ("plain", SQ(0.0, 0.0)), ("null", None)])
    got = {x.areaId: x.g for x in df.select("areaId", geo.split_at_antimeridian("geometry").alias("g")).collect()}
    assert len(got["line"]) == 2 and all(-180 <= p.x <= 180 for poly in got["line"] for ring in poly for p in ring) and got["null"] is None
    assert [[tuple(p) for p in ring] for ring in got["plain"][0]] == [[(p["x"], p["y"]) for p in SQ(0.0, 0.0)[0][0]]]
    c = df.where("areaId = 'plain'").select(*geo.centroid(F.col("geometry"))).collect()[0]
    assert tuple(c) == (0.5, 0.5)


def test_checks_of_areas(spark):
    turned = [[list(reversed(SQ(20.0, 0.0)[0][0]))]]
    rows = [
        ("a", SQ(0.0, 0.0, 2.0)), ("b", SQ(1.0, 1.0, 2.0)), ("c", SQ(20.0, 0.0)), ("d", turned), ("open", [[SQ(40.0, 0.0)[0][0][:-1]]]),
        ("flat", [[[{"x": x, "y": 0.0} for x in (50.0, 51.0, 52.0, 50.0)]]]), ("nan", [[[{"x": math.nan, "y": 0.0}, *SQ(60.0, 0.0)[0][0]]]]), ("e", None), ("touch", SQ(21.0, 0.0)),
        ("many", [[SQ(70.0, 0.0)[0][0][:-1], SQ(70.0, 0.0)[0][0][:3]], []]), (None, SQ(80.0, 0.0)), ("a", SQ(0.0, 0.0, 2.0)), ("odd", SQ(90.0, 0.0)), ("mute", SQ(91.0, 5.0)),
    ]
    features = spark.createDataFrame(
        [(k, k, f"AA:overture:{k}" if k != "odd" else "AA:other:odd", "AA", "AA", None if k == "mute" else "n", g) for k, g in rows],
        f"divisionId string, sourceId string, areaId string, countryCode string, owner string, nameLocal string, geometry {geo.GEOM}",
    )
    expected = spark.createDataFrame([("AA", "exact", 3, None, None)], "countryCode string, kind string, value int, minimum int, maximum int")
    index = spark.createDataFrame([("AA", "AA:overture:a")], "countryCode string, areaId string")
    exceptions = spark.createDataFrame([("e1", "overlap", "b", "a"), ("e2", "other", "x", "y"), ("e3", "overlap", "x", "x")], "id string, kind string, a string, b string")
    sizes = spark.createDataFrame([("AA", 21 * 1024 * 1024)], "countryCode string, bytes bigint")
    wanted = [
        ("DUPLICATE_GEOMETRY", "c|d"), ("RING_NOT_CLOSED", "open"), ("RING_ZERO_AREA", "flat"), ("COORDINATE_INVALID", "nan"), ("GEOMETRY_TYPE_INVALID", "e"),
        ("RING_NOT_CLOSED", "many"), ("RING_TOO_SHORT", "many"), ("GEOMETRY_EMPTY", "many"), ("DIVISION_ID_DUPLICATE", "a"), ("IDENTITY_MISMATCH", "odd"), ("LOCAL_NAME_MISSING", "mute"),
        ("COUNT_MISMATCH", None), ("PACKAGE_TOO_LARGE", None),
    ]
    key = lambda rows: sorted(rows, key=str)
    audited = regions.audit(features, expected, index, exceptions, sizes).collect()
    codes = [(r.code, r.subject) for r in audited]
    assert ("INDEX_ID_MISMATCH", None) in codes
    assert key(c for c in codes if c[0] != "INDEX_ID_MISMATCH") == key([*wanted, ("DIVISION_ID_MISSING", None), ("EXCEPTION_INVALID", "e2"), ("EXCEPTION_INVALID", "e3")])
    left = regions.geometry_codes(features, exceptions.where("id = 'none'")).where("code = 'OVERLAP_UNEXPLAINED'").collect()
    assert [r.subject for r in left] == ["a|b"]
    m = regions.metrics(features, sizes).collect()[0]
    assert (m.features, m.warning, m.failure) == (14, "PACKAGE_SIZE_P95_EXCEEDED", "PACKAGE_TOO_LARGE") and m.most == 5
    none = features.limit(0)
    assert regions.audit(none, expected, index.limit(0), exceptions.limit(0), sizes).collect() == []


def test_large_rings_are_compared_in_bounded_memory():
    """Two rings of 50,000 points: dense matrices of their edges would take tens of gigabytes."""
    import tracemalloc

    t = np.linspace(0, 2 * np.pi, 50_000)
    ring = lambda x, y, r: np.vstack([(c := np.column_stack([x + r * np.cos(t), y + r * np.sin(t)]))[:-1], c[:1]])
    tracemalloc.start()
    assert geo.polygons_overlap([ring(0, 0, 2.0)], [ring(3, 0, 2.0)])
    assert not geo.polygons_overlap([ring(0, 0, 2.0), ring(0, 0, 1.5)], [ring(0, 0, 1.0)])
    assert not geo.polygons_overlap([ring(0, 0, 1.0)], [ring(1.5, 1.5, 1.0)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000


def test_polygon_tests_against_brute_force():
    rng = np.random.default_rng(9)

    def blob(n):
        a = np.sort(rng.random(n) * 2 * np.pi)
        r = rng.random(n) + 0.3
        p = np.column_stack([rng.random() * 3 + r * np.cos(a), rng.random() * 3 + r * np.sin(a)])
        return np.vstack([p, p[:1]])

    def turn(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return 0 if abs(v) < 1e-12 else math.copysign(1, v)

    def inside(p, ring):
        odd = False
        for a, b in zip(ring[:-1], ring[1:]):
            if turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
        return 1 if odd else -1

    def overlap(one, two):
        for a, b in zip(one[:-1], one[1:]):
            for c, d in zip(two[:-1], two[1:]):
                if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                    return True
        return any(inside(p, two) == 1 for p in one[:-1]) or any(inside(p, one) == 1 for p in two[:-1])

    for _ in range(60):
        one, two = blob(rng.integers(3, 12)), blob(rng.integers(3, 12))
        assert geo.polygons_overlap([one], [two]) == overlap(one, two)
        pts = np.vstack([rng.random((20, 2)) * 4, one[:3], (one[0] + one[1])[None] / 2])
        assert geo.in_ring(pts, one).tolist() == [inside(p, one) for p in pts]


def test_simplifying_keeps_what_it_promises(spark):
    t = np.linspace(0, 2 * np.pi, 300)
    ring = np.column_stack([10 + np.cos(t) + 0.01 * np.sin(40 * t), 60 + np.sin(t)])
    ring[-1] = ring[0]
    for tolerance in (0.002, 0.02):
        kept = np.flatnonzero(geo.kept_points(ring, tolerance))
        for i, j in zip(kept[:-1], kept[1:]):  # every point left out is within the tolerance of the line that replaces it
            d, m = ring[j] - ring[i], ring[i + 1 : j] - ring[i]
            assert not len(m) or (np.abs(d[0] * m[:, 1] - d[1] * m[:, 0]) / np.hypot(*d) <= tolerance + 1e-12).all()
    few, fewer = geo.visvalingam(ring, 1e-5), geo.visvalingam(ring, 1e-2)
    assert 4 <= len(fewer) < len(few) < 300 and (few[0] == few[-1]).all()
    assert len(geo.visvalingam(ring, 1e9)) == 4 and len(geo.visvalingam(ring, 0.0)) == 300
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    df = shapes(spark, [("a", [[list(map(point, ring))], [list(map(point, ring + 5))]]), ("null", None), ("empty", [])])
    rows = {r.areaId: r for r in df.select("areaId", geo.simplified(1e-4, projected=True)("geometry").alias("p"), geo.presimplified(1e-4)("geometry").alias("v")).collect()}
    assert rows["null"].p is None and rows["empty"].v == [] and len(rows["a"].p) == 2 and 4 <= len(rows["a"].v[1][0]) < 300


def test_small_boxes_under_a_world_wide_one_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(regions.nearby, "BLOCK", 20)
    rows = [("world", SQ(-170.0, -80.0, 150.0))] + [(f"k{i:03}", SQ(-100.0 + i * 0.3, -20.0, 0.1)) for i in range(120)]
    got = {tuple(r) for r in regions.overlaps(shapes(spark, rows)).collect()}
    assert got == {(f"k{i:03}", "world") for i in range(120)}


def test_overlaps_across_the_antimeridian_and_sizes(spark):
    crossing = [[[{"x": x, "y": y} for x, y in ((179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0), (179.0, 0.0))]]]
    rows = [("crossing", crossing), ("near", SQ(-180.0, 1.0, 2.0)), ("far", SQ(0.0, 0.0)), ("tiny", SQ(0.3, 0.3, 0.05)), ("huge", SQ(-5.0, -5.0, 20.0))]
    df = shapes(spark, rows)
    assert sorted(tuple(r) for r in regions.overlaps(df).collect()) == [("crossing", "near"), ("far", "huge"), ("far", "tiny"), ("huge", "tiny")]
    left = regions.unexplained(regions.overlaps(df), spark.createDataFrame([("tiny", "huge"), ("near", "far")], "a string, b string"))
    assert sorted(tuple(r) for r in left.collect()) == [("crossing", "near"), ("far", "huge"), ("far", "tiny")]


def test_simplify_keeps_shape():
    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.column_stack([np.cos(t), np.sin(t)])
    ring[-1] = ring[0]
    out = geo.simplify_ring(ring, 0.01)
    assert 10 < len(out) < 60 and (out[0] == out[-1]).all()


def test_text_expressions(spark):
    rows = [("2024",), ("2024-07",), ("2024-02-29",), ("",), ("24",), ("2024-13",), ("2023-02-29",), ("2024-04-31",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "d string").select(text.date_precision(F.col("d")).alias("p")).collect()]
    assert got == ["year", "month", "day", None, None, None, None, None, None]
    r = one(spark, text.release_id(F.lit("2026-02-30.0")).alias("a"), text.release_id(F.lit("2026-02-28.10")).alias("b"), text.truncated(F.lit("a😀cdef"), 3).alias("c"),
            text.area_id(F.lit("CN"), F.lit("s"), F.lit("a:b")).alias("d"), text.bounded(F.lit("　 x  "), 5).alias("e"), text.is_whole(F.lit("9007199254740992")).alias("f"),
            text.xml_escaped(F.lit("a<\u0001&'")).alias("g"), text.utc_instant(F.lit("2026-02-30T00:00:00.000Z")).alias("h"), text.country_code(F.lit("cn\n")).alias("i"))
    assert tuple(r) == (None, "2026-02-28.10", "a😀…", None, "x", False, "a&lt;&amp;&apos;", None, None)


def test_readers_and_writers(spark, tmp_path):
    t = tmp_path
    (t / "names.txt").write_text("1\t7\tzh\t慕尼黑\t1\t\t\t\n2\t7\tde\tx\t\t\t\t\n3\t8\tzh-CN\ty\t\t\t\t\n")
    assert sorted((r.cityId, r.name, r.is_preferred) for r in readers.alternate_names(spark, str(t / "names.txt")).collect()) == [(7, "慕尼黑", True), (8, "y", False)]
    (t / "bad.txt").write_text("1\ta\tb\n")
    with pytest.raises(Exception, match="bad row"):
        readers.cities_tsv(spark, str(t / "bad.txt")).collect()
    (t / "AA.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "n", "id": "7"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    f = readers.feature_collection(spark, str(t / "AA.geojson")).collect()[0]
    assert (f.code, f.kind, f.properties["id"]) == ("AA", "Polygon", "7")
    df = spark.createDataFrame([("AA", 1), ("AA", 2), ("BB", 3), ("b", 4), (None, 5)], "countryCode string, v int")
    writers.partitioned(df, str(t / "p"))
    assert sorted(r.v for r in readers.partitioned(spark, str(t / "p"), values=["AA"]).collect()) == [1, 2]
    writers.unresolved(df, str(t / "u"), "countryCode", "v")
    assert sorted(r.v for r in readers.parquet(spark, str(t / "u")).collect()) == [4, 5]
    listed = readers.files(spark, str(t / "p"), "*.parquet", content=True).collect()
    assert listed and all(len(r.sha256) == 64 and r.byteSize > 0 for r in listed)
    writers.document({"b": 1, "a": [None]}, str(t / "x.json"))
    assert (t / "x.json").read_text() == '{"a":[null],"b":1}\n'
    (t / "s1").mkdir(), (t / "s1" / "f").write_text("new"), (t / "d1").mkdir(), (t / "d1" / "f").write_text("old")
    with pytest.raises(OSError):
        writers.promote({str(t / "s1"): str(t / "d1"), str(t / "missing"): str(t / "d2")})
    assert (t / "d1" / "f").read_text() == "old"
    a, b = (writers.checksum(df.repartition(n), "v").collect()[0] for n in (1, 3))
    assert a == b and a.rows == 5


def test_topology_and_backup(spark):
    topo = {
        "transform": {"scale": [0.5, 0.5], "translate": [10, 20]}, "arcs": [[[0, 0], [2, 0], [0, 2]], [[0, 0], [0, 2], [2, 0]]],
        "objects": {"areas": {"geometries": [{"id": "a", "type": "Polygon", "arcs": [[[0, -2]]]}]}},
    }
    r = readers.topology(spark.createDataFrame([(json.dumps(topo),)], "package string")).collect()[0]
    assert [(p.x, p.y) for p in r.rings[0]] == [(10, 20), (11, 20), (11, 21), (10, 21), (10, 20)]
    doc = json.dumps({"schemaVersion": 1, "title": "t", "visits": [{"cityId": 1, "note": "n", "extra": 1}], "boundaries": []})
    assert [(v.cityId, v.note) for v in readers.backup(spark.createDataFrame([(doc,)], "document string"))["visits"].collect()] == [(1, "n")]
    with pytest.raises(Exception, match="schemaVersion"):
        readers.backup(spark.createDataFrame([('{"schemaVersion": 9}',)], "document string"))["visits"].collect()


def test_stream_merge(spark, tmp_path):
    s = "k string, t int, v string"
    source, at, offsets = (str(tmp_path / x) for x in ("in", "table", "offsets"))
    for rows in ([("a", 1, "x"), ("b", 2, "x")], [("a", 2, "y"), ("b", 1, "y"), ("c", 0, "y")]):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(source)
        merge.upsert_stream(spark.readStream.schema(s).parquet(source), at, ["k"], "t", offsets)
    schema = spark.createDataFrame([], s).schema
    assert sorted(map(tuple, merge.latest(spark, at, schema).collect())) == [("a", 2, "y"), ("b", 2, "x"), ("c", 0, "y")]
    assert os.path.isdir(at)
    # a batch of one key writes one bucket, and versions of a bucket before the last two are removed
    before = merge._versions(spark, at)
    for t in (5, 6, 7):
        spark.createDataFrame([("a", t, f"v{t}")], s).coalesce(1).write.mode("append").parquet(source)
        merge.upsert_stream(spark.readStream.schema(s).parquet(source), at, ["k"], "t", offsets)
    after = merge._versions(spark, at)
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and len(after[changed[0]]) == 2 and sorted(map(tuple, merge.latest(spark, at, schema).collect()))[0] == ("a", 7, "v7")
    assert merge.latest(spark, str(tmp_path / "none"), schema).collect() == []


def test_mapped_status(spark):
    p = spark.createDataFrame([("1", "AA"), ("2", "AA"), ("3", "AA"), ("4", "ZZ"), ("5", None)], "key string, countryCode string")
    pairs = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "x"), ("4", "x")], "key_a string, key_b string")
    got = {r.key: (r.status, r.areas) for r in visits.mapped(p, pairs, spark.createDataFrame([("AA",)], "countryCode string")).collect()}
    assert got == {"1": ("resolved", ["x"]), "2": ("ambiguous", ["x", "y"]), "3": ("outside", None), "4": ("country-unavailable", None), "5": ("country-unavailable", None)}


def test_bounded_trims_as_javascript_does(spark):
    space = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    texts = [space + "北京" + space, "“x” \x85", "x\u2028", "a\u3000b", "😀" * 500, "😀" * 501, "é" * 500 + space, "\u200bx", "\u2000" * 600, "a\x7fb", ""]

    def kept(t):
        t = t.strip(space)
        return t if 1 <= len(t) <= 500 and not any(ord(c) < 32 or ord(c) == 127 for c in t) else None

    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", text.bounded(F.col("t"), 500).alias("kept"))
    assert {r.n: r.kept for r in df.collect()} == {n: kept(t) for n, t in enumerate(texts)}


def test_every_document_is_bounded(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert function_queries.x5_x7_all(spark, DATA).count() == docs.count()


def test_rings_across_the_antimeridian_are_wound(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    outer = ring((179, 10), (-179, 10), (-179, 12), (179, 12), (179, 10))
    hole = ring((179.5, 10.5), (179.5, 11), (-179.5, 11), (-179.5, 10.5), (179.5, 10.5))
    half = ring((0, 0), (180, 0), (180, 1), (0, 1), (0, 0))
    df = shapes(spark, [("right", [[outer, hole]]), ("wrong", [[outer[::-1], hole[::-1]]]), ("half", [[half]]), ("empty", [[[]]])])
    rows = df.select("areaId", geo.ring_area(F.col("geometry")[0][0]).alias("area"), geo.wound(F.col("geometry")).alias("w")).collect()
    got = {r.areaId: (r.area, [[(p.x, p.y) for p in x] for x in r.w[0]]) for r in rows}
    wanted = [[(p["x"], p["y"]) for p in x] for x in (outer, hole)]
    assert got["right"] == (4, wanted) and got["wrong"] == (-4, wanted)
    assert got["half"][0] == 180 and got["empty"][0] == 0


def test_areas_of_every_ring_are_returned(spark):
    c = spark.read.parquet(f"{DATA}/boundary_candidate.parquet").where("geometry IS NOT NULL").select("id").distinct()
    assert function_queries.a20_all(spark, DATA).count() == c.count()
    a = spark.read.parquet(f"{DATA}/city_area.parquet").dropDuplicates(["areaId"]).where("geometry IS NOT NULL")
    signs = function_queries.g15_rings(spark, DATA).select("ring_no", F.signum("area").alias("sign"))
    assert signs.count() == a.select(F.sum(F.size(F.flatten("geometry")))).collect()[0][0]
    assert signs.where((F.col("ring_no") == 1) != (F.col("sign") == 1)).count() == 0


def test_path_numbers_are_rounded_by_their_exact_value(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, -0.0001, 0.0005, 1.0005, -1.0005, 2.0625, -2.0625, 0.1875, 179.9995, 179.9994999, 0.0004999, 1e-300, 5e8 + 0.0625, 999.9995]
    values += [round(draw.uniform(-180, 180), 3) + draw.choice((0.0005, -0.0005)) for _ in range(2000)] + [draw.uniform(-180, 180) for _ in range(500)]
    values += [math.nextafter(k / 16, d) for k in range(-99, 99) for d in (-1e3, 1e3)]

    def brute(v):
        n = abs(decimal.Decimal(v)).quantize(decimal.Decimal("0.001"), decimal.ROUND_HALF_UP)
        return ("-" if v < 0 else "") + str(n)

    got = spark.createDataFrame(list(enumerate(values)), "n int, v double").select("n", geo.fixed(F.col("v"), 3).alias("f")).collect()
    assert {r.n: r.f for r in got} == {n: brute(v) for n, v in enumerate(values)}


def test_path_of_several_polygons_and_holes(spark):
    rings = [SQ(0.0, 0.0, 3.0)[0][0], SQ(1.0, 1.0)[0][0], SQ(9.0, -0.0005)[0][0]]
    r = shapes(spark, [("a", [rings[:2], rings[2:]])]).select(geo.svg_path(F.col("geometry")).alias("p")).collect()[0].p
    assert r == (
        "M0.000 0.000L3.000 0.000L3.000 3.000L0.000 3.000L0.000 0.000ZM1.000 1.000L2.000 1.000L2.000 2.000L1.000 2.000L1.000 1.000Z"
        "M9.000 -0.001L10.000 -0.001L10.000 1.000L9.000 1.000L9.000 -0.001Z"
    )


def test_every_geometry_has_a_path(spark):
    wanted = sum(spark.read.parquet(f"{DATA}/{t}.parquet").where("geometry IS NOT NULL").select(k).distinct().count() for t, k in (("boundary_candidate", "id"), ("city_area", "areaId")))
    assert function_queries.g14_all(spark, DATA).where("path LIKE 'M%Z'").count() == wanted


def test_every_ring_is_rotated(spark, tmp_path):
    a, b, c = (SQ(x, 0.0)[0][0][1:] + SQ(x, 0.0)[0][0][1:2] for x in (0.0, 3.0, 9.0))
    shapes(spark, [("a", [[a, b], [c]])]).write.parquet(str(tmp_path / "city_area.parquet"))
    rows = function_queries.r8_all(spark, str(tmp_path)).collect()
    assert sorted((r.polygon, r.ring_no, r.at, r.rotated.split()[0]) for r in rows) == [(1, 1, 3, "0.000000"), (1, 2, 3, "3.000000"), (2, 1, 3, "9.000000")]


def test_readers_get_all_valid_ids_and_alternate_names(spark, tmp_path):
    record = lambda k, people="7": "\t".join([k, "n", "n", "", "1", "2", "", "", "DE", "", "", "", "", "", people, "", "", "", ""])
    ids = ["1", "999999999999999", "9007199254740991", "9007199254740992", "0" * 20 + "5", "x", ""]
    raw = [(i, "cities500", record(k)) for i, k in enumerate(ids)] + [(90, "cities500", record("8", "")), (91, "cities500", record("9", "-1")), (92, "cities500", "1\t2")]
    spark.createDataFrame(raw, "record_no bigint, feed string, record string").write.parquet(str(tmp_path / "city_raw.parquet"))
    assert sorted(r.id for r in io_queries.s4_all(spark, str(tmp_path)).collect()) == [1, 5, 8, 999999999999999, 9007199254740991]
    city(spark, CITIES[:2]).write.parquet(str(tmp_path / "city_summary.parquet"))
    assert [tuple(r) for r in io_queries.s5(spark, str(tmp_path)).collect()] == [(1, "zh", "慕尼黑", True)]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from cartomill import runtime

    class Context:
        master = "spark://there:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(Session())
