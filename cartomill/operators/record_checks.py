"""Rows that fail to parse: separate them with a reason while loading the rest.

Every record is read permissively under an explicit typed schema; what does not fit
(another number of columns, an id or population that is no number, a quote that never
closes) keeps its raw text in ``corrupt``. The read decides: a record it takes loads
with the values it read, once they are in range and the country is known. Only records
with corrupt text are split and reclassified by quoting, field count and cast checks,
and beside them the few forms the reader takes for good although they are not:
``AS_IF_GOOD`` names them. The first check that holds is the reason. Everything runs
in the JVM, one pass, without a shuffle; the country codes are broadcast only while
their table is small (``CODES_LIMIT`` rows), else joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of each feed and positions of the checked ones.
FEEDS = {
    "cities500": {"sep": "\t", "fields": 19, "at": {"id": 0, "name": 1, "asciiName": 2, "aliases": 3, "lat": 4, "lon": 5, "countryCode": 8, "admin1": 10, "population": 14}},
    "compact": {"sep": ",", "fields": 11, "at": {"id": 0, "name": 1, "asciiName": 2, "aliases": 3, "countryCode": 4, "continentCode": 5, "lat": 6, "lon": 7, "zhName": 8, "admin1": 9, "population": 10}},
}
LARGEST_ID = 9007199254740991
CODES_LIMIT = 100_000
#: A quoted field, and a record of quoted and plain fields; possessive, so of bounded stack on any length.
QUOTED = r'"(?:[^"]++|"")*+"'
COMPACT = rf'\A(?:{QUOTED}|[^",]*+)(?:,(?:{QUOTED}|[^",]*+))*+\z'


def body(record: Column) -> Column:
    """The record without one carriage return at its end."""
    return F.when(record.endswith("\r"), F.expr("left(_record, length(_record) - 1)")).otherwise(record)


def _whole_number(x: Column) -> Column:
    """True for digits 0-9 only, of value at most LARGEST_ID; false for null."""
    digits = F.regexp_replace(x, r"\A0+(?=[0-9])", "")
    return F.coalesce(
        x.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 16) & (digits.try_cast("bigint") <= LARGEST_ID), F.lit(False)
    )


def _fields(feed: str, text: Column) -> Column:
    """All fields of a record as text; quotes of compact fields are removed and doubled ones halved."""
    if feed == "cities500":
        return F.split(text, "\t", -1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf",({QUOTED}|[^,]*+)"), 1)
    return F.transform(
        raw,
        lambda f: F.when(
            f.startswith('"') & f.endswith('"') & (F.length(f) >= 2),
            F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )


#: What the reader takes although it is wrong: quotes in or after a field of a compact
#: record, and numbers with a sign or with digits other than 0-9. Of a record of these
#: forms the read is not believed; it is reclassified as a corrupt one is.
AS_IF_GOOD = {
    "cities500": lambda text: ~text.rlike(r"\A[0-9]*\t") | ~F.split_part(text, F.lit("\t"), F.lit(15)).rlike(r"\A[0-9]*\z"),
    "compact": lambda text: text.contains('"') | ~text.rlike(r"\A[0-9]*,") | ~text.rlike(r",[0-9]*\z"),
}
#: Typed columns of the read; all others are text, as nothing else is checked.
TYPED = {"id": "bigint", "population": "bigint"}


def read(feed: str, text: Column) -> Column:
    """One permissive read of a record: its named values, typed, and ``corrupt``, the text of one that does not fit."""
    spec = FEEDS[feed]
    names = {i: what for what, i in spec["at"].items()}
    columns = [f"c{i} {TYPED.get(names.get(i), 'string')}" for i in range(spec["fields"])]
    options = {"sep": spec["sep"], "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1"}
    options |= {"quote": '"', "escape": '"'} if feed == "compact" else {"quote": ""}
    row = F.from_csv(text, ", ".join([*columns, "_corrupt string"]), options)
    value = lambda what: row[f"c{spec['at'][what]}"] if what in spec["at"] else F.lit(None).cast("string")
    return F.struct(row["_corrupt"].alias("corrupt"), *[value(what).alias(what) for what in FEEDS["compact"]["at"]])


def classify(raw: DataFrame, countries: DataFrame, feed_col: str = "feed", record_col: str = "record") -> DataFrame:
    """record_no, feed, record of all records with ``reason`` (null: loads), ``is_empty``, ``corrupt``, ``_read`` and ``fields``.

    ``corrupt`` is the text of a record the typed read could not take; ``fields`` is
    null for records that were not reclassified. Empty and null records have
    ``is_empty`` and no reason. A record of an unknown or null feed has the reason
    ``feed``. Repeated records are kept. A country code that repeats in ``countries``
    counts once; null codes match nothing.
    """
    codes = countries.select(F.col("countryCode").alias("_code")).where("_code IS NOT NULL").distinct()
    if codes.limit(CODES_LIMIT + 1).count() <= CODES_LIMIT:
        codes = F.broadcast(codes)
    text, feed = F.col("_text"), F.col("feed")

    def by_feed(make):
        return reduce(lambda acc, f: acc.when(feed == f, make(f)), list(FEEDS)[1:], F.when(feed == list(FEEDS)[0], make(list(FEEDS)[0])))

    pick = lambda what: by_feed(lambda f: F.get(F.col("fields"), F.lit(FEEDS[f]["at"][what])))
    # only these columns go on, so that no other can clash
    df = (
        raw.select("record_no", F.col(feed_col).alias("feed"), F.col(record_col).alias("record")).withColumn("_record", F.col("record"))
        .withColumn("_text", body(F.col("_record")))
        .withColumn("is_empty", text.isNull() | (text == ""))
        .withColumn("_read", F.when(~F.col("is_empty"), by_feed(lambda f: read(f, text))))
        .withColumn("corrupt", F.col("_read.corrupt"))
        .withColumn("_again", F.coalesce(F.col("corrupt").isNotNull() | by_feed(lambda f: AS_IF_GOOD[f](text)), F.lit(False)))
        .withColumn("fields", F.when(F.col("_again"), by_feed(lambda f: _fields(f, text))))
        .withColumn("_cc", F.when(F.col("_again"), pick("countryCode")).otherwise(F.col("_read.countryCode")))
        .join(codes, F.col("_cc") == F.col("_code"), "left")
    )
    split_at = by_feed(
        lambda f: F.size(F.split(text, "\t", -1)) if f == "cities500" else F.size(F.split(F.regexp_replace(text, QUOTED, ""), ",", -1))
    )
    population = F.coalesce(pick("population"), F.lit(""))
    again = (
        F.when((feed == "compact") & ~text.rlike(COMPACT), "quoting")
        .when(split_at != by_feed(lambda f: F.lit(FEEDS[f]["fields"])), "column_count")
        .when(~_whole_number(pick("id")), "id")
        .when(F.col("_code").isNull(), "country_code")
        .when((population != "") & ~_whole_number(population), "population")
    )
    taken = (
        F.when(F.col("_read.id").isNull() | (F.col("_read.id") > LARGEST_ID), "id")
        .when(F.col("_code").isNull(), "country_code")
        .when(F.col("_read.population") > LARGEST_ID, "population")
    )
    reason = (
        F.when(F.col("is_empty"), F.lit(None).cast("string"))
        .when(feed.isNull() | ~feed.isin(*FEEDS), "feed")
        .when(F.col("_again"), again)
        .otherwise(taken)
    )
    return df.withColumn("reason", reason).drop("_record", "_text", "_code", "_cc")


def rejected(raw: DataFrame, countries: DataFrame) -> DataFrame:
    """record_no and reason of the records that do not load."""
    return classify(raw, countries).where(F.col("reason").isNotNull()).select("record_no", "reason")


def loaded(raw: DataFrame, countries: DataFrame) -> DataFrame:
    """The valid records as cities; empty fields become null, repeated records stay."""
    df = classify(raw, countries).where(F.col("reason").isNull() & ~F.col("is_empty"))

    def value(what: str) -> Column:
        col = F.lit(None).cast("string")
        for f, spec in FEEDS.items():
            if what in spec["at"]:
                col = F.when(F.col("feed") == f, F.get("fields", F.lit(spec["at"][what]))).otherwise(col)
        return F.when(F.col("_again"), F.nullif(col, F.lit(""))).otherwise(F.nullif(F.col(f"_read.{what}").cast("string"), F.lit("")))

    def typed(what: str) -> Column:
        return F.when(F.col("_again"), value(what).cast("bigint")).otherwise(F.col(f"_read.{what}"))

    return df.select(
        "record_no",
        typed("id").alias("id"),
        value("name").alias("name"),
        value("asciiName").alias("asciiName"),
        F.split(value("aliases"), ",").alias("aliases"),
        value("countryCode").alias("countryCode"),
        value("continentCode").alias("continentCode"),
        value("lat").try_cast("double").alias("lat"),
        value("lon").try_cast("double").alias("lon"),
        value("zhName").alias("zhName"),
        value("admin1").alias("admin1"),
        typed("population").alias("population"),
    )
