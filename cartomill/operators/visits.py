"""Statistics, history and consolidation of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators.relational import first_by, union_all

NOTE_LIMIT, PAGE = 500, 6


#: The continents.
CONTINENTS = ("AF", "AN", "AS", "EU", "NA", "OC", "SA")


def stats(visits: DataFrame) -> DataFrame:
    """One row: cities, countries, continents as a map; the first visit of a city counts.

    visits: (cityId, countryCode, continentCode, ordinal). An empty table gives 0, 0 and
    an empty map; null countries and unknown continents count for nothing. One aggregate
    gives all: a count for each of the seven continents.
    """
    first = first_by(visits, ["cityId"], F.col("ordinal"))
    counts = [F.struct(F.lit(c).alias("k"), F.count_if(F.col("continentCode") == c).cast("int").alias("n")) for c in CONTINENTS]
    whole = first.agg(
        F.count("*").alias("city_count"), F.countDistinct("countryCode").alias("country_count"), F.array(*counts).alias("p")
    )
    return whole.select(
        "city_count", "country_count", F.map_from_entries(F.filter("p", lambda e: e["n"] > 0)).alias("continent_counts")
    )


def area_visits(visits: DataFrame, areas: DataFrame) -> DataFrame:
    """Visits of areas with ``areaSnapshot``, what the area was at the time; those of unknown areas are left out.

    visits: (areaId, createdAt, updatedAt, visitedOn, datePrecision, note).
    """
    what = F.struct("areaId", "countryCode", "sourceId", "adminLevel", "nameZh", "nameLocal", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "centroid")
    return visits.join(areas.select("areaId", what.alias("areaSnapshot")), "areaId")


#: What a backup may hold.
BACKUP = {"visits": 10_000, "boundaries": 10_000, "vertices": 1_000_000, "note": 500}


def backup_codes(visits: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(subject, code) of what is wrong with the visits and boundaries of one backup; a sound one gives no rows.

    visits: (cityId, createdAt, updatedAt, visitedOn, datePrecision, note); boundaries:
    (cityId, geometry). Subject is the cityId as text, null for the budgets.
    """
    none = F.lit(None).cast("string")
    day = text.date_precision(F.col("visitedOn"))
    dated = F.col("visitedOn").isNotNull() | F.col("datePrecision").isNotNull()
    flags = F.array(
        F.when(F.col("cityId").isNull() | (F.col("cityId") <= 0), "CITY_ID_INVALID"),
        F.when(text.utc_instant(F.col("createdAt")).isNull() | text.utc_instant(F.col("updatedAt")).isNull(), "TIMESTAMP_INVALID"),
        F.when(~F.coalesce(text.updated_in_order(F.col("createdAt"), F.col("updatedAt")), F.lit(True)), "UPDATED_BEFORE_CREATED"),
        F.when(dated & ~day.eqNullSafe(F.col("datePrecision")), "DATE_INVALID"),
        F.when(F.col("note").isNotNull() & text.bounded(F.col("note"), BACKUP["note"]).isNull() & (text.trimmed(F.col("note")) != ""), "NOTE_INVALID"),
    )
    subject = F.col("cityId").cast("string").alias("subject")
    rows = visits.select(subject, F.explode(F.filter(flags, lambda c: c.isNotNull())).alias("code"))
    twice = lambda df, code: df.groupBy("cityId").count().where("count > 1").select(subject, F.lit(code).alias("code"))
    broken = boundaries.where(F.size(geo.problems(F.col("geometry"))) > 0).select(subject, F.lit("GEOMETRY_INVALID").alias("code"))
    over = lambda df, n, most, code: df.agg(n.alias("n")).where(F.col("n") > most).select(none.alias("subject"), F.lit(code).alias("code"))
    vertices = F.coalesce(F.sum(geo.vertices(F.col("geometry"))), F.lit(0))
    return union_all(
        rows, twice(visits, "VISIT_DUPLICATE"), broken, twice(boundaries, "BOUNDARY_DUPLICATE"), over(visits, F.count("*"), BACKUP["visits"], "TOO_MANY_VISITS"),
        over(boundaries, F.count("*"), BACKUP["boundaries"], "TOO_MANY_BOUNDARIES"), over(boundaries, vertices, BACKUP["vertices"], "TOO_MANY_VERTICES"),
    ).distinct()


def totals(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """One row: distinct cities and areas visited, and the distinct countries of either; nulls count for nothing."""
    side = lambda df, k, kind: df.select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("k"), "countryCode")
    both = side(cities, "cityId", "city").unionByName(side(areas, "areaId", "area"))
    of = lambda kind: F.countDistinct(F.when(F.col("kind") == kind, F.col("k")))
    return both.agg(of("city").alias("cities"), of("area").alias("areas"), F.countDistinct("countryCode").alias("countries"))


def history(df: DataFrame, stamp: str, *ties: str) -> DataFrame:
    """Newest first, with position and page number of pages of six.

    Positions come from a distributed sort: ranks inside days, days offset by the counts
    of later days, so no task holds all rows.
    """
    day = F.to_date(stamp)
    w = Window.partitionBy("_day").orderBy(F.col(stamp).desc_nulls_last(), *[F.col(t) for t in ties])
    days = df.groupBy(day.alias("_day")).count()
    offset = days.withColumn("_off", F.sum("count").over(Window.orderBy(F.col("_day").desc_nulls_last())) - F.col("count")).drop("count")
    ranked = df.withColumn("_day", day).withColumn("_rn", F.row_number().over(w))
    return (
        ranked.join(offset, ranked["_day"].eqNullSafe(offset["_day"])).drop(offset["_day"])
        .withColumn("position", (F.col("_rn") + F.col("_off")).cast("bigint"))
        .withColumn("page", F.ceil(F.col("position") / PAGE).cast("bigint")).drop("_rn", "_off", "_day")
    )


def page(ordered: DataFrame, wanted: int) -> DataFrame:
    """One page of history(); a page beyond the last is the last, one below the first the first."""
    last = ordered.agg(F.greatest(F.lit(1), F.least(F.lit(max(wanted, 1)), F.coalesce(F.max("page"), F.lit(1)))).cast("bigint").alias("page"))
    return ordered.join(F.broadcast(last), "page")  # one row


#: Columns of a visit that consolidate() reads; those in the second list may be missing.
VISIT, MAY_LACK = ["areaId", "cityId", "label", "createdAt", "updatedAt", "note"], ["visitedOn", "datePrecision", "areaSnapshot"]


def _accepted(visits: DataFrame) -> DataFrame:
    """(areaId, note, taken) of the notes that fit, in order of city and update.

    Of notes of one length those that fit are the first ones, at most as many as the
    limit holds, as the room never grows: no others are collected, so that an area of any
    size has a group of at most some thousand lines.
    """
    line = F.concat(F.coalesce("label", F.lit("")), F.lit("："), F.col("note"))
    lines = visits.where("note <> ''").withColumn("line", line).withColumn("n", F.char_length("line"))
    order = ["cityId", "updatedAt", "createdAt", "line"]
    w = Window.partitionBy("areaId", "n").orderBy(*order)
    few = lines.where(F.col("n") <= NOTE_LIMIT).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.floor(F.lit(NOTE_LIMIT + 1) / (F.col("n") + 1)))
    row = F.struct(*order, *[c for c in visits.columns if c not in ("areaId", *order)])
    start = F.struct(F.lit("").alias("note"), F.array().cast("array<int>").alias("taken"))

    def step(acc, x):
        joined = F.when(acc["note"] == "", x["r"]["line"]).otherwise(F.concat(acc["note"], F.lit("\n"), x["r"]["line"]))
        fits = F.char_length(joined) <= NOTE_LIMIT
        return F.struct(F.when(fits, joined).otherwise(acc["note"]).alias("note"), F.when(fits, F.array_append(acc["taken"], x["i"])).otherwise(acc["taken"]).alias("taken"))

    numbered = F.transform("rows", lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    folded = few.groupBy("areaId").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("f", F.aggregate(numbered, start, step))
    return folded.select("areaId", F.col("f.note").alias("joined"), F.transform("f.taken", lambda i: F.get("rows", i)).alias("taken"))


def _visits(visits: DataFrame) -> DataFrame:
    known = visits.columns
    columns = [F.col(c) for c in VISIT if c != "note"] + [F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in MAY_LACK]
    return visits.where("areaId IS NOT NULL").select(*columns, F.coalesce("note", F.lit("")).alias("note"))


def kept_visits(visits: DataFrame) -> DataFrame:
    """The visits that consolidate() takes into their area's one: the rest are overflow().

    All without a note, those whose note fits, the only one of an area, and the first of
    an area where none else is kept.
    """
    v = _visits(visits)
    columns = v.columns
    taken = _accepted(v).select("areaId", F.explode("taken").alias("r")).select(*[F.col(c) if c == "areaId" else F.col(f"r.{c}").alias(c) for c in columns])
    usual = v.where("note = ''").unionByName(taken)
    first = v.groupBy("areaId").agg(F.min(F.struct("cityId", "updatedAt", *[c for c in columns if c not in ("areaId", "cityId", "updatedAt")])).alias("r"))
    lone = first.join(usual.select("areaId").distinct(), "areaId", "left_anti").select(*[F.col(c) if c == "areaId" else F.col(f"r.{c}").alias(c) for c in columns])
    return usual.unionByName(lone)


def overflow(visits: DataFrame) -> DataFrame:
    """The visits that stay apart, as their notes did not fit; repeated rows count by number."""
    v = _visits(visits)
    return v.exceptAll(kept_visits(visits).select(*v.columns))


def consolidate(visits: DataFrame) -> DataFrame:
    """One visit per area from (areaId, cityId, label, createdAt, updatedAt, note) and,
    if there are such columns, visitedOn, datePrecision and areaSnapshot; see overflow() for the rest.

    Notes join in order of (cityId, updatedAt) as ``label：note`` lines while they stay
    within 500 code points; one that does not fit is left out, a later shorter one may
    still fit; empty notes take no room. A single visit stays as it is; so does the first
    if none fits. Over the kept visits: the newest, by updatedAt and cityId, gives
    ``newest_city`` and areaSnapshot, createdAt is the least, updatedAt the greatest, and
    the earliest visitedOn of those that have a datePrecision too gives both. Rows
    without an area are left out; an empty table gives none.
    """
    v = _visits(visits)
    counts = v.groupBy("areaId").agg(F.count("*").alias("n"))
    dated = F.when(F.col("visitedOn").isNotNull() & F.col("datePrecision").isNotNull(), F.struct("visitedOn", "cityId", "updatedAt", "datePrecision"))
    one = kept_visits(visits).groupBy("areaId").agg(
        F.max(F.struct("updatedAt", "cityId", "areaSnapshot")).alias("newest"), F.min("createdAt").alias("createdAt"), F.min(dated).alias("dated"),
        F.first("note").alias("own"), F.first("visitedOn").alias("own_day"), F.first("datePrecision").alias("own_precision"),
    )
    joined = counts.join(one, "areaId").join(_accepted(v).select("areaId", "joined"), "areaId", "left")
    # a visit that is the only one of its area keeps a date without precision, too
    alone = F.col("n") == 1
    return joined.select(
        "areaId", F.col("newest.areaSnapshot").alias("areaSnapshot"),
        F.when(alone, F.col("own")).otherwise(F.coalesce(F.nullif("joined", F.lit("")), F.col("own"))).alias("note"),
        F.col("newest.cityId").alias("newest_city"), "createdAt", F.col("newest.updatedAt").alias("updatedAt"),
        F.when(alone, F.col("own_day")).otherwise(F.col("dated.visitedOn")).alias("visitedOn"),
        F.when(alone, F.col("own_precision")).otherwise(F.col("dated.datePrecision")).alias("datePrecision"),
    )


def mapped(points: DataFrame, pairs: DataFrame, covered: DataFrame) -> DataFrame:
    """(key, status, areas) of points: resolved in one area, ambiguous, outside, country-unavailable.

    points: (key, countryCode); pairs: (key_a, key_b) of containing(); covered: countries with areas.
    """
    inside = pairs.groupBy(F.col("key_a").alias("key")).agg(F.array_sort(F.collect_set("key_b")).alias("areas"))
    known = covered.select("countryCode").distinct().withColumn("_known", F.lit(True))
    n = F.coalesce(F.size("areas"), F.lit(0))
    return points.join(known, "countryCode", "left").join(inside, "key", "left").select(
        "key",
        F.when(F.col("_known").isNull(), "country-unavailable").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("outside").alias("status"),
        F.when(F.col("_known").isNotNull(), F.col("areas")).alias("areas"),
    )
