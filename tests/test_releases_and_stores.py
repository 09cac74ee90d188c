"""Release reports, bindings, stores, backups and index records on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators import changes_of_releases as cr
from cartomill.operators import relational, store, visits
from cartomill.sources import readers, writers


def test_report(spark):
    s = "k string, g string, h string, before string"
    old = spark.createDataFrame([("a", "A", "1", "x"), ("b", "A", "1", "x"), ("c", "B", None, "x"), ("d", "C", "1", "x"), (None, "A", "1", "x")], s)
    new = spark.createDataFrame([("a", "A", "2", "x"), ("c", "B", None, "x"), ("e", "D", "1", "x")], s)
    got = {r.g: (r.before, r.after, r.added, r.deleted, r.changed, r.delta, r.state) for r in cr.report(old, new, "k", "g", "h", most=5.0).collect()}
    assert got == {
        "A": (2, 1, 0, 1, 1, 50.0, "blocked"), "B": (1, 1, 0, 0, 0, 0.0, "no-review-required"),
        "C": (1, 0, 0, 1, 0, 100.0, "manual-review-required"), "D": (0, 1, 1, 0, 0, 100.0, "manual-review-required"),
    }
    assert cr.report(old.limit(0), new.limit(0), "k", "g", "h", most=5.0).collect() == []


def test_migration_types_and_bindings(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d"), ("c", "e"), ("f", "h"), ("g", "h"), ("i", "j"), ("i", "k"), ("l", "k")], "old_id string, new_id string")
    got = {(r.old_id, r.new_id): r.type for r in cr.migration_types(pairs).collect()}
    assert got == {("a", "b"): "1-1", ("c", "d"): "1-n", ("c", "e"): "1-n", ("f", "h"): "n-1", ("g", "h"): "n-1", ("i", "j"): "1-n", ("i", "k"): "n-n", ("l", "k"): "n-1"}
    side = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    b = cr.bindings({"one": side(("x", 1), ("y", 2)), "two": side(("x", 1), ("y", None)), "three": side(("x", 3))}, "k", "n", [("one", "two"), ("two", "three")])
    assert {r.k: r.codes for r in b.collect()} == {"x": ["two-three:DIFFERENT"], "y": ["three:MISSING"]}


def test_stores(spark):
    s = spark.createDataFrame([("b", 1), ("a", 2), ("Z", 3), (None, 4)], "k string, v int")
    assert [r.k for r in store.listed(s, "k").collect()] == ["a", "b", "Z"]
    assert sorted(r.v for r in store.put(s, spark.createDataFrame([("b", 9), (None, 8)], s.schema), "k").where("k IS NOT NULL").collect()) == [2, 3, 9]
    assert sorted(r.k for r in store.delete(s, spark.createDataFrame([("b",), ("none",)], "k string"), "k").where("k IS NOT NULL").collect()) == ["Z", "a"]
    assert [r.v for r in store.get(s, "k", ["a"]).collect()] == [2] and store.get(s, "k", []).collect() == []
    with pytest.raises(Exception, match="duplicate k"):
        store.put(s, spark.createDataFrame([("b", 9), ("b", 8)], s.schema), "k").collect()
    assert [tuple(r) for r in relational.positions(store.listed(s, "k").select("k")).collect()] == [("a", 1), ("b", 2), ("Z", 3)]


def test_backup_codes(spark):
    at = "2026-01-02T00:00:00.000Z"
    v = [(1, at, at, "2026-01", "month", "ok"), (2, at, "2026-01-01T00:00:00.000Z", None, None, None), (0, "2026", at, None, None, " "), (3, at, at, "2026-02-30", "day", "x\u0001"), (4, at, at, "2026", None, "y" * 501), (4, at, at, None, None, "")]
    visits_ = spark.createDataFrame(v, "cityId bigint, createdAt string, updatedAt string, visitedOn string, datePrecision string, note string")
    b = spark.createDataFrame([(1, None), (7, [])], f"cityId bigint, geometry {geo.GEOM}")
    got = sorted((r.subject, r.code) for r in visits.backup_codes(visits_, b).collect())
    assert got == sorted([
        ("2", "UPDATED_BEFORE_CREATED"), ("0", "CITY_ID_INVALID"), ("0", "TIMESTAMP_INVALID"), ("3", "DATE_INVALID"), ("3", "NOTE_INVALID"), ("4", "DATE_INVALID"), ("4", "NOTE_INVALID"),
        ("4", "VISIT_DUPLICATE"), ("1", "GEOMETRY_INVALID"), ("7", "GEOMETRY_INVALID"),
    ])
    assert visits.backup_codes(visits_.limit(0), b.limit(0)).collect() == []
    with pytest.raises(Exception, match="too many visits"):
        writers.backup_document(visits_, b, "t", at, most=2).collect()


def test_bounded_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": 1}))
    assert [tuple(r) for r in readers.bounded_json(spark, str(tmp_path), "k int", 100).collect()] == [("a.json", 1)]
    for content, says in ((b"\xef\xbb\xbf{}", "byte order mark"), (b"", "empty"), (b"{" + b" " * 200, "too large"), (b'"\xff"', "not UTF-8")):
        (tmp_path / "a.json").write_bytes(content)
        with pytest.raises(Exception, match=says):
            readers.bounded_json(spark, str(tmp_path), "k int", 100).collect()
    with pytest.raises(FileNotFoundError):
        readers.listed(spark, [str(tmp_path / "none.parquet")], "k int", 10)
    with pytest.raises(ValueError, match="no files"):
        readers.listed(spark, [], "k int", 10)
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="are allowed"):
        readers.listed(spark, [str(tmp_path / "p")], "id bigint", 10)


def test_index_records(spark):
    rows = [("country", "AA", "v", None), ("area", "AA", "v", "AA:1"), ("area", "AA", "w", "AA:2"), ("area", "BB", "v", "BB:1"), ("area", "AA", "v", "XX:1"), ("area", "AA", "v", "AA:3"), ("area", "AA", "v", "AA:3"), ("odd", "AA", "v", None)]
    df = spark.createDataFrame(rows, "kind string, countryCode string, boundaryVersion string, areaId string")
    got = sorted((r.areaId or r.kind, r.code) for r in readers.index_codes(df).collect())
    assert got == sorted([
        ("country", None), ("AA:1", None), ("AA:2", "VERSION_MISMATCH"), ("BB:1", "COUNTRY_MISSING"), ("XX:1", "ID_COUNTRY_MISMATCH"), ("AA:3", "DUPLICATE_IDENTITY"), ("AA:3", "DUPLICATE_IDENTITY"), ("odd", "KIND_INVALID"),
    ], key=lambda x: (x[0], x[1] or ""))


def test_text_helpers(spark):
    r = spark.range(1).select(
        text.canonical_text(F.lit('{"b": {"z": 1, "a": [2, {"y": 0, "x": null}]}, "a": "ü"}')).alias("c"), text.canonical_text(F.lit("{bad")).alias("n"),
        text.html_safe_json(F.lit("<a>& ")).alias("h"), text.is_form(F.lit("123e4567-e89b-12d3-a456-426614174000"), "uuid").alias("u"), text.is_form(F.lit(None).cast("string"), "uuid").alias("v"),
        text.secret_findings(F.lit("see /home/me, api_key: 1 at 2026-01-01T00:00")).alias("s"), text.secret_findings(F.lit(None).cast("string")).alias("e"),
    ).collect()[0]
    assert r.c == '{"a":"ü","b":{"a":[2,{"x":null,"y":0}],"z":1}}' and r.n is None
    assert r.h == "\\u003ca\\u003e\\u0026\\u2028" and r.u is True and r.v is False
    assert r.s == ["absolute-path", "secret-key", "timestamp"] and r.e == []
