from pyspark.sql import functions as F

from cartomill.operators import record_checks as rc

GOOD_TSV = "\t".join(["12", 'na"me', "n", "a,b", "1.5", "2.5", "P", "PPL", "AA", "", "01", "", "", "", "77", "", "1", "tz", "2026-01-01"])


def reasons(spark, records, codes=("AA", "NA")):
    rows = [(i, f, r, "x", "x") for i, (f, r) in enumerate(records)]
    raw = spark.createDataFrame(rows, "record_no bigint, feed string, record string, reason string, fields string")
    info = spark.createDataFrame([(c, 1) for c in codes], "countryCode string, _code int")
    return dict(rc.rejected(raw, info).collect())


def compact(**change):
    f = dict(id="12", name="n", asciiName="n", aliases='"a,b"', cc="AA", cont="EU", lat="1", lon="2", zh="", adm="", pop="5") | change
    return ",".join(f.values())


CASES = [
    (("cities500", GOOD_TSV), None),
    (("cities500", GOOD_TSV + "\r"), None),
    (("cities500", GOOD_TSV + "\r\r"), None),  # the second is part of the last field
    (("cities500", ""), None),
    (("cities500", "\r"), None),
    (("compact", None), None),
    (("cities500", GOOD_TSV.replace("\t77\t", "\t77 \t")), "population"),
    (("cities500", GOOD_TSV.replace("12\t", "12a\t", 1)), "id"),
    (("cities500", GOOD_TSV + "\t"), "column_count"),
    (("cities500", GOOD_TSV.replace("\tAA\t", "\taa\t")), "country_code"),
    (("compact", compact()), None),
    (("compact", compact(cc="NA")), None),
    (("compact", compact(name='"a ""b"", c\nd"')), None),
    (("compact", compact(name='""')), None),
    (("compact", compact(name='"""x"')), None),
    (("compact", compact(name='a"b')), "quoting"),
    (("compact", compact(name='"ab"c')), "quoting"),
    (("compact", compact(pop='"5')), "quoting"),
    (("compact", compact(aliases="a,b")), "column_count"),
    (("compact", compact(id="")), "id"),
    (("compact", compact(id="9007199254740992")), "id"),
    (("compact", compact(id="9007199254740991")), None),
    (("compact", compact(id="0009007199254740991")), None),
    (("compact", compact(id="1" * 60)), "id"),
    (("compact", compact(id="１２")), "id"),
    (("compact", compact(id='"12"', cc='"AA"', pop='"7"')), None),
    (("compact", compact(pop="")), None),
    (("compact", compact(pop="-1")), "population"),
    (("compact", compact(pop="+1")), "population"),
    (("compact", compact(id="+12")), "id"),
    (("cities500", GOOD_TSV.replace("12\t", "１2\t", 1)), "id"),
    (("cities500", GOOD_TSV.replace("\t77\t", "\t7７\t")), "population"),
    (("cities500", GOOD_TSV.replace("\t77\t", "\t9007199254740992\t")), "population"),
    (("cities500", GOOD_TSV + "\nx"), None),  # a line break is a character of its field
    (("cities500", GOOD_TSV.replace("12\t", "#12\t", 1)), "id"),
    (("compact", compact(name='""', asciiName='"x" ')), "quoting"),
    (("compact", compact(id="x", cc="??", pop="?")), "id"),
    (("compact", compact(cc="??", pop="?")), "country_code"),
    (("compact", compact(name='"' + 'a""' * 50_000 + '"')), None),  # very long, many doubled quotes
    (("compact", compact(name="y" * 200_000)), None),
    (("other", "x"), "feed"),
    ((None, "x"), "feed"),
]


def test_reasons(spark):
    got = reasons(spark, [c for c, _ in CASES])
    assert {i: got.get(i) for i in range(len(CASES))} == {i: r for i, (_, r) in enumerate(CASES)}


def test_empty_tables(spark):
    assert reasons(spark, []) == {}
    assert reasons(spark, [("compact", compact())], codes=()) == {0: "country_code"}


def test_loaded_rows_and_repeats(spark):
    raw = spark.createDataFrame([(1, "compact", compact(aliases='"a,b"')), (2, "compact", compact(aliases='"a,b"')), (3, "compact", "x"), (4, "compact", "")], "record_no bigint, feed string, record string")
    info = spark.createDataFrame([("AA",), ("AA",), (None,)], "countryCode string")
    rows = sorted(rc.loaded(raw, info).collect())
    assert [r.record_no for r in rows] == [1, 2]
    assert rows[0].aliases == ["a", "b"] and rows[0].population == 5 and rows[0].zhName is None


def test_the_read_decides(spark, monkeypatch):
    """Sound records load as the reader read them; without the read nothing loads, and its corrupt text is what is reclassified."""
    raw = spark.createDataFrame([(1, "compact", compact(aliases="ab")), (2, "compact", compact(id="12x")), (3, "compact", "1,2"), (4, "cities500", GOOD_TSV)], "record_no bigint, feed string, record string")
    info = spark.createDataFrame([("AA",)], "countryCode string")
    rows = {r.record_no: r for r in rc.classify(raw, info).collect()}
    assert {k: r.corrupt is not None for k, r in rows.items()} == {1: False, 2: True, 3: True, 4: False}
    assert {k: r.fields is not None for k, r in rows.items()} == {1: False, 2: True, 3: True, 4: False}
    assert rows[1]._read.id == 12 and rows[1]._read.population == 5
    right = dict(rc.rejected(raw, info).collect())
    assert right == {2: "id", 3: "column_count"} and rc.loaded(raw, info).count() == 2
    real = rc.read

    def off(feed, text):
        row = real(feed, text)
        return F.struct(*[F.lit(None).cast(t).alias(n) for n, t in [("corrupt", "string")] + [(w, rc.TYPED.get(w, "string")) for w in rc.FEEDS["compact"]["at"]]]) if row is not None else row

    monkeypatch.setattr(rc, "read", off)
    assert dict(rc.rejected(raw, info).collect()) != right and rc.loaded(raw, info).count() == 0
