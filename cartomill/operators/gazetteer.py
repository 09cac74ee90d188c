"""Search, nearest places and ranking of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartomill.functions import geo, text
from cartomill.operators.relational import assert_unique


def search_cities(cities: DataFrame, query: str | None, limit: float) -> DataFrame:
    """O3: best matches: exact, prefix, substring; then population, name, id.

    A blank query, a limit that is no number or below 1 give no rows. Terms are name,
    asciiName, zhName and aliases; null terms match nothing, null population is 0.
    """
    n = 0 if limit is None or math.isnan(limit) or limit < 1 else int(min(limit, 2**31 - 1))
    key = text.search_key(F.lit(query or ""))
    terms = F.concat(F.array("name", "asciiName", "zhName"), F.coalesce("aliases", F.array().cast("array<string>")))
    # one Arrow call a row: terms are joined by a separator the key keeps no part of
    joined = F.array_join(F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.replace(t, F.lit("\x1f"), F.lit(" "))), "\x1f")
    hits = cities.withColumn("_keys", F.split(text.search_key(joined), "\x1f")).withColumn("_q", key)
    rank = F.array_min(F.transform("_keys", lambda t: text.match_rank(F.trim(t), F.col("_q"))))
    return (
        hits.where(F.col("_q") != "").withColumn("match_rank", rank).where("match_rank IS NOT NULL")
        .orderBy("match_rank", F.coalesce("population", F.lit(0)).desc(), F.collate("name", "en"), "id").limit(n).drop("_keys", "_q")
    )


def search_areas(areas: DataFrame, query: str | None, limit: float) -> DataFrame:
    """Areas by match rank, countries first, then field, Chinese order of the name shown, and id.

    Fields are the distinct names nameZh, nameLocal and aliases, nulls left out, in this
    order; ``field_rank`` is the place of the best match among them and ``matched_name``
    its text. A column ``kind`` (country or area) is used if there is one. A blank query,
    one of more than 160 code points, and a limit that is no number or not above 0 give
    no rows.
    """
    q = (query or "").strip()
    n = 0 if not q or len(q) > 160 or limit is None or not math.isfinite(limit) or limit <= 0 else int(limit)
    names = F.array_distinct(F.filter(F.concat(F.array("nameZh", "nameLocal"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda t: t.isNotNull()))
    joined = F.array_join(F.transform(names, lambda t: F.replace(t, F.lit("\x1f"), F.lit(" "))), "\x1f")
    hits = areas.withColumn("_names", names).withColumn("_keys", F.split(text.area_key(joined), "\x1f")).withColumn("_q", text.area_key(F.lit(q)))
    best = F.array_min(
        F.filter(
            F.transform("_keys", lambda t, i: F.struct(text.match_rank(F.trim(t), F.col("_q")).alias("match_rank"), i.alias("field_rank"))),
            lambda s: s["match_rank"].isNotNull(),
        )
    )
    kind = [F.when(F.col("kind") == "country", 0).otherwise(1)] if "kind" in areas.columns else []
    return (
        hits.withColumn("_best", best).where("_best IS NOT NULL")
        .withColumn("match_rank", F.col("_best.match_rank")).withColumn("field_rank", F.col("_best.field_rank"))
        .withColumn("matched_name", F.get("_names", F.col("field_rank")))
        .orderBy("match_rank", *kind, "field_rank", F.collate(F.coalesce("nameZh", "nameLocal"), "zh"), F.collate("areaId", "en"), "areaId").limit(n)
        .drop("_names", "_keys", "_q", "_best")
    )


def nearest(cities: DataFrame, lon: float, lat: float, limit: float) -> DataFrame:
    """The nearest rows of a point by distance, population, id; a point off the globe has none.

    The scan keeps the best rows of each partition (TakeOrderedAndProject): no shuffle.
    """
    good = all(v is not None and math.isfinite(v) for v in (lon, lat)) and abs(lat) <= 90
    n = 0 if not good or limit is None or math.isnan(limit) or limit < 1 else int(limit)
    from cartomill.operators.nearby import usable

    return (
        cities.where(usable(F.col("lat"), F.col("lon")))
        .withColumn("km", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(float(lat or 0)), F.lit(float(lon or 0))), 6))
        .orderBy("km", F.coalesce("population", F.lit(0)).desc(), "id").limit(n)
    )


#: Points of a name kind, of an exact name, of a part of the address, of a matching type.
KIND_POINTS = {"zhName": 50, "name": 40, "asciiName": 30, "aliases": 20}
NAME_POINTS, PART_POINTS, TYPE_POINTS = 1000, 500, 10


def rank_candidates(cities: DataFrame, candidates: DataFrame, order: str = "id", types: tuple[str, ...] = ("administrative", "city", "town", "municipality")) -> DataFrame:
    """(city_id, candidate_id, score, position) of candidates that name a city of their country.

    Names are compared without accents, case and outer spaces. An exact name beats a part
    of the address line; importance adds at most one; ties go by ``order``, the column of
    the candidates that numbers them. One equi-join on country and name; rows repeat once.
    """
    own = F.concat(
        F.array(*[F.struct(F.col(kind).alias("t"), F.lit(KIND_POINTS[kind]).alias("points")) for kind in ("zhName", "name", "asciiName")]),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("t"), F.lit(KIND_POINTS["aliases"]).alias("points"))),
    )
    names = cities.select("id", F.upper("countryCode").alias("countryCode"), F.explode(own).alias("t")).select(
        "id", "countryCode", text.candidate_key(F.col("t.t")).alias("term"), F.col("t.points").alias("points")
    ).where("term <> ''").groupBy("id", "countryCode", "term").agg(F.max("points").alias("points"))
    said = candidates.select(
        F.col("id").alias("candidate_id"), F.col(order).alias("_order"), F.upper("countryCode").alias("countryCode"), "type", "importance",
        text.candidate_key(F.col("name")).alias("whole"), text.candidate_key(F.col("displayName")).alias("line"),
    )
    parts = said.withColumn("s", F.explode(F.concat(
        F.array(F.struct(F.col("whole").alias("term"), F.lit(NAME_POINTS).alias("base"))),
        F.transform(F.split(F.coalesce("line", F.lit("")), ","), lambda p: F.struct(text.trimmed(p).alias("term"), F.lit(PART_POINTS).alias("base"))),
    ))).select("candidate_id", "_order", "countryCode", "type", "importance", "s.term", "s.base").where("term <> ''")
    score = (
        F.col("base") + F.col("points")
        + F.when(F.col("type").isin(*types), TYPE_POINTS).otherwise(0)
        + F.when(F.isnan("importance"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.0)))))
    )
    best = parts.join(names, ["countryCode", "term"]).groupBy(F.col("id").alias("city_id"), "candidate_id", "_order").agg(F.round(F.max(score), 6).alias("score"))
    w = Window.partitionBy("city_id").orderBy(F.desc("score"), "_order", "candidate_id")
    return best.withColumn("position", F.row_number().over(w)).drop("_order")


def preferred_names(names: DataFrame) -> DataFrame:
    """(cityId, preferred, aliases) from (cityId, language, name, is_preferred).

    Preferred names first, then zh-CN, then by code unit; other names follow once each.
    """
    rank = F.struct(
        F.when(F.col("is_preferred"), 0).otherwise(1).alias("a"), F.when(F.col("language") == "zh-CN", 0).otherwise(1).alias("b"), F.col("name")
    )
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(rank)), lambda s: s["name"]))
    return names.where("name IS NOT NULL AND language IN ('zh', 'zh-CN')").groupBy("cityId").agg(ordered.alias("_all")).select(
        "cityId", F.element_at("_all", 1).alias("preferred"), F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))).alias("aliases")
    )


ALIASES = 3


def unique_strings(names: Column) -> Column:
    """The texts trimmed, each once in order, blank ones and nulls left out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, none), lambda a: text.trimmed(a)), lambda a: a != ""))


def source_aliases(aliases: Column, name: Column, ascii_name: Column, zh: Column) -> Column:
    """the distinct aliases that are neither name nor asciiName nor a Chinese alias."""
    none = F.array().cast("array<string>")
    other = F.concat(F.array(name, ascii_name), F.coalesce(zh, none))
    return F.filter(unique_strings(aliases), lambda a: ~F.coalesce(F.array_contains(other, a), F.lit(False)))


def kept_aliases(aliases: Column, name: Column, ascii_name: Column, zh_preferred: Column, zh: Column, most: int = ALIASES) -> Column:
    """the first ``most`` source aliases, then the Chinese ones that are no name of the city, each once."""
    none = F.array().cast("array<string>")
    names = F.array(zh_preferred, name, ascii_name)
    chinese = F.filter(F.coalesce(zh, none), lambda a: ~F.coalesce(F.array_contains(names, a), F.lit(False)))
    return unique_strings(F.concat(F.slice(source_aliases(aliases, name, ascii_name, zh), 1, most), chinese))


def refused_cities(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """(id, code) of the rows build_cities() fails on, but for repeated ids: the same tests as a table."""
    known = countries.select("countryCode").distinct().withColumn("_known", F.lit(True))
    code = F.when(~_right(), "INVALID_REQUIRED_VALUE").when(F.col("_known").isNull(), "UNKNOWN_COUNTRY")
    return rows.join(known, "countryCode", "left").select("id", code.alias("code")).where("code IS NOT NULL")


def _right() -> Column:
    in_range = lambda c, m: F.coalesce(~F.isnan(c) & F.col(c).between(-m, m), F.lit(False))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.col("id").isNotNull() & given("name") & given("asciiName") & given("countryCode") & in_range("lat", 90) & in_range("lon", 180)


def build_cities(rows: DataFrame, countries: DataFrame, names: DataFrame) -> DataFrame:
    """Gazetteer rows as cities; ``truncated`` says whether aliases were cut.

    rows: (id, name, asciiName, aliases, lat, lon, countryCode, admin1, population);
    countries: (countryCode, continentCode); names: (cityId, preferred, aliases). A
    missing id, name or country code, a position that is no number or off the globe, an
    unknown country and a repeated id fail the query that reads the rows, with the id.
    Without Chinese names zhName is null. Empty tables give no rows.
    """
    fail = lambda says, c: F.raise_error(F.concat(F.lit(says), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    rows = rows.select("id", "name", "asciiName", "aliases", "lat", "lon", "countryCode", "admin1", "population")
    checked = assert_unique(rows.where(F.when(~_right(), fail("invalid required value of city ", "id")).otherwise(True)), "id")
    known = countries.select("countryCode", "continentCode").distinct()
    zh = names.select(F.col("cityId").alias("id"), F.col("preferred").alias("zhName"), F.col("aliases").alias("_zh"))
    joined = checked.join(known, "countryCode", "left").where(F.when(F.col("continentCode").isNull(), fail("unknown country code ", "countryCode")).otherwise(True)).join(zh, "id", "left")
    args = [F.col("name"), F.col("asciiName")]
    return joined.select(
        "id", "name", "asciiName", kept_aliases(F.col("aliases"), *args, F.col("zhName"), F.col("_zh")).alias("aliases"), "countryCode", "continentCode", "lat", "lon", "zhName",
        F.nullif("admin1", F.lit("")).alias("admin1"), "population", (F.size(source_aliases(F.col("aliases"), *args, F.col("_zh"))) > ALIASES).alias("truncated"),
    )
