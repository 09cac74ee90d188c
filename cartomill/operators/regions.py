"""Overlaps between areas and checks of their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartomill import runtime
from cartomill.functions import geo, text
from cartomill.operators import nearby
from cartomill.operators.relational import union_all

#: Degrees of the finest grid level; each level doubles it.
FINEST, LEVELS = 0.01, 16


def overlap_candidates(areas: DataFrame, key: str = "areaId", geometry: str = "geometry") -> DataFrame:
    """(a, b) pairs, a < b, whose boxes overlap strictly; boxes across the antimeridian meet shifted copies.

    Spark plans a nested loop for box predicates; here every box is filed under the at
    most four cells of the grid level of its own size, and looked up under its cells of
    each coarser level that occurs, so that both joins are equi-joins on a cell.
    """
    boxed = areas.where(F.col(geometry).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), geo.unwrapped_box(geometry).alias("b"))
    boxes = boxed.select("k", "b.*").where("min_x IS NOT NULL AND min_y IS NOT NULL AND NOT isnan(min_x) AND NOT isnan(min_y)").dropDuplicates(["k"])
    # boxes are read by several branches below; computed once, they are five columns
    boxes = runtime.cut(boxes)
    # all boxes begin in -180..180; copies reach what lies a turn away
    turn = F.floor((F.col("min_x") + 180) / 360) * 360
    boxes = boxes.withColumn("_turn", turn).select("k", (F.col("min_x") - F.col("_turn")).alias("min_x"), (F.col("max_x") - F.col("_turn")).alias("max_x"), "min_y", "max_y")
    boxes = union_all(
        boxes.withColumn("turned", F.lit(False)),
        boxes.where("max_x > 180").select("k", (F.col("min_x") - 360).alias("min_x"), (F.col("max_x") - 360).alias("max_x"), "min_y", "max_y", F.lit(True).alias("turned")),
    )
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(FINEST))
    boxes = boxes.withColumn("level", F.least(F.lit(LEVELS), F.ceil(F.log2(extent / FINEST))).cast("int"))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # at most LEVELS + 1
    size = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("at"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    spread = (
        boxes.withColumn("at", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("level"))))
        .withColumn("cx", F.explode(span("min_x", "max_x"))).withColumn("cy", F.explode(span("min_y", "max_y")))
    )
    # a box filed at its own level asks, all that are spread over that level answer; a crowded cell
    # (all small boxes under a world-wide one) is joined in blocks of both sides
    cell = F.concat_ws("/", F.col("at").cast("string"), F.col("cx").cast("string"), F.col("cy").cast("string"))
    placed = spread.withColumn("cell", cell).withColumn("asks", F.col("at") == F.col("level")).withColumn("answers", F.lit(True)).withColumnRenamed("k", "key")
    met = nearby.spread(placed.select("cell", "key", "asks", "answers", "min_x", "max_x", "min_y", "max_y"))
    l, r = met.where("asks").alias("l"), met.where("answers").alias("r")
    pairs = l.join(r, (F.col("l.task") == F.col("r.task")) & (F.col("l.key") != F.col("r.key"))
        & (F.col("l.min_x") < F.col("r.max_x")) & (F.col("r.min_x") < F.col("l.max_x")) & (F.col("l.min_y") < F.col("r.max_y")) & (F.col("r.min_y") < F.col("l.max_y")))
    return pairs.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")).distinct()


def overlaps(areas: DataFrame, key: str = "areaId", geometry: str = "geometry") -> DataFrame:
    """Pairs whose polygons cross or nest; touching and equal ones do not."""
    pairs = overlap_candidates(areas, key, geometry)
    shape = areas.where(F.col(geometry).isNotNull()).select(F.col(key).alias("k"), F.col(geometry).alias("g")).dropDuplicates(["k"])
    both = pairs.join(shape.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(
        shape.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b"
    )
    # the exact test costs far more than its bytes say: keep it on all cores, also where pairs are few
    n = runtime.parallelism(areas.sparkSession)
    return both.repartition(n, "a", "b").where(geo.overlap("ga", "gb")).select("a", "b")


def unexplained(pairs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Pairs without an exception, whichever way round an exception names them."""
    known = exceptions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(known, ["a", "b"], "left_anti")


#: Bytes of a package that are remarked on, and that are too many.
WARN_BYTES, MOST_BYTES = 5 * 1024 * 1024, 20 * 1024 * 1024


def count_codes(counts: DataFrame) -> DataFrame:
    """V2: (countryCode, code) of counts against their expectation, from (countryCode, n, kind, value, minimum, maximum).

    kind ``exact`` asks for value, ``range`` (or none, with both bounds) for minimum to
    maximum. An expectation of another kind, or none, is COUNT_REFERENCE_INVALID; one
    whose bounds are null, negative or the wrong way round is a COUNT_MISMATCH.
    """
    bounds = F.col("minimum").isNotNull() & F.col("maximum").isNotNull()
    in_range = F.coalesce(bounds & (F.col("minimum") >= 0) & (F.col("maximum") >= F.col("minimum")) & F.col("n").between(F.col("minimum"), F.col("maximum")), F.lit(False))
    code = (
        F.when((F.col("kind") == "range") | (F.col("kind").isNull() & bounds), F.when(~in_range, "COUNT_MISMATCH"))
        .when(F.col("kind") == "exact", F.when(~F.coalesce(F.col("n") == F.col("value"), F.lit(False)), "COUNT_MISMATCH"))
        .otherwise("COUNT_REFERENCE_INVALID")
    )
    return counts.select("countryCode", code.alias("code")).where("code IS NOT NULL")


def feature_codes(features: DataFrame) -> DataFrame:
    """V1: (countryCode, code, subject) of what single features and their ids say; subject is the divisionId, or null.

    features: (divisionId, sourceId, areaId, countryCode, nameLocal, geometry), of the
    country that ``countryCode`` names in ``owner``. A blank divisionId is none.
    """
    f = features.withColumn("_id", F.when(F.trim("divisionId") != "", F.col("divisionId")))
    expected = F.concat_ws(":", F.col("owner"), F.lit("overture"), F.col("_id"))
    mismatch = F.col("_id").isNotNull() & ~(F.col("sourceId").eqNullSafe(F.col("_id")) & F.col("areaId").eqNullSafe(expected) & F.col("countryCode").eqNullSafe(F.col("owner")))
    flags = F.array(
        F.when(F.col("_id").isNull(), "DIVISION_ID_MISSING"), F.when(mismatch, "IDENTITY_MISMATCH"),
        F.when(F.coalesce(text.trimmed(F.col("nameLocal")) == "", F.lit(True)), "LOCAL_NAME_MISSING"),
    )
    codes = F.filter(F.concat(flags, geo.problems(F.col("geometry"))), lambda c: c.isNotNull())
    single = f.select(F.col("owner").alias("countryCode"), F.explode(codes).alias("code"), F.col("_id").alias("subject"))
    twice = f.where("_id IS NOT NULL").groupBy("owner", "_id").count().where("count > 1")
    return single.unionByName(twice.select(F.col("owner").alias("countryCode"), F.lit("DIVISION_ID_DUPLICATE").alias("code"), F.col("_id").alias("subject")))


def index_codes(features: DataFrame, index: DataFrame) -> DataFrame:
    """V1: INDEX_ID_MISMATCH of countries whose areaIds and those of the index (countryCode, areaId) are not the same, each once."""
    side = lambda df, code, name: df.where("areaId IS NOT NULL").groupBy(F.col(code).alias("countryCode"), "areaId").agg(F.count("*").alias(name))
    both = side(features, "owner", "a").join(side(index, "countryCode", "b"), ["countryCode", "areaId"], "full")
    odd = both.where(~((F.col("a") == 1) & (F.col("b") == 1)) | F.col("a").isNull() | F.col("b").isNull())
    return odd.select("countryCode").distinct().select("countryCode", F.lit("INDEX_ID_MISMATCH").alias("code"), F.lit(None).cast("string").alias("subject"))


def geometry_codes(features: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """V1: DUPLICATE_GEOMETRY and OVERLAP_UNEXPLAINED of the sound geometries of a country; subject ``a|b``, a < b.

    A geometry that several ids share gives one row for each after the first, with it.
    exceptions: (a, b), either way round.
    """
    sound = runtime.cut(
        features.where(F.col("divisionId").isNotNull() & (F.size(geo.problems(F.col("geometry"))) == 0)).dropDuplicates(["owner", "divisionId"])
        .select("owner", "divisionId", "geometry")
    )
    shapes = sound.select("owner", "divisionId", F.sha2(geo.canonical("geometry"), 256).alias("h"))
    first = shapes.groupBy("owner", "h").agg(F.min("divisionId").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pair = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    twice = shapes.join(first, ["owner", "h"]).where("divisionId <> first").select(
        F.col("owner").alias("countryCode"), F.lit("DUPLICATE_GEOMETRY").alias("code"), pair(F.col("first"), F.col("divisionId")).alias("subject")
    )
    # one pass for all countries: pairs of one country count
    keyed = sound.select(F.concat_ws("\t", "owner", "divisionId").alias("k"), "geometry")
    part = lambda c, i: F.split_part(F.col(c), F.lit("\t"), F.lit(i))
    pairs = overlaps(keyed, "k", "geometry").select(part("a", 1).alias("countryCode"), part("b", 1).alias("_other"), part("a", 2).alias("a"), part("b", 2).alias("b")).where("countryCode = _other")
    left = pairs.select("countryCode", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if exceptions is not None:
        left = left.join(exceptions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return twice.unionByName(left.select("countryCode", F.lit("OVERLAP_UNEXPLAINED").alias("code"), F.concat_ws("|", "a", "b").alias("subject")))


def exception_codes(exceptions: DataFrame) -> DataFrame:
    """V1: (code, subject) EXCEPTION_INVALID of exceptions (id, kind, a, b) without a safe id, of another kind, of one division, or repeated."""
    safe = lambda c, most: F.coalesce(F.col(c).rlike(r"\A[^\x00-\x1f\x7f]+\z") & (F.char_length(c) <= most) & (F.trim(c) == F.col(c)), F.lit(False))
    good = safe("id", 128) & F.coalesce(F.col("kind") == "overlap", F.lit(False)) & safe("a", 400) & safe("b", 400) & F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    key = F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))
    marked = exceptions.select("id", good.alias("good"), key.alias("pair"))
    times = lambda c: F.count("*").over(Window.partitionBy("good", c))
    bad = ~F.col("good") | (times("id") > 1) | (times("pair") > 1)
    return marked.withColumn("bad", bad).where("bad").select(F.lit("EXCEPTION_INVALID").alias("code"), F.col("id").alias("subject"))


def metrics(features: DataFrame, sizes: DataFrame) -> DataFrame:
    """V1: (countryCode, features, vertices, p50, p95, most, bytes, warning, failure) of sound geometries; sizes: (countryCode, bytes).

    Percentiles are nearest-rank over vertices per feature, exact; 0 where a country has no sound geometry.
    """
    n = F.when(F.size(geo.problems(F.col("geometry"))) == 0, geo.vertices(F.col("geometry")))
    per = features.select(F.col("owner").alias("countryCode"), n.alias("n"))
    # ranks from the counts of each number of vertices: no task sorts a country's features
    w = Window.partitionBy("countryCode")
    bins = per.where("n IS NOT NULL").groupBy("countryCode", "n").agg(F.count("*").alias("m"))
    ranked = bins.withColumn("upto", F.sum("m").over(w.orderBy("n"))).withColumn("c", F.sum("m").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("c") * q), F.col("n")))
    ranks = ranked.groupBy("countryCode").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    whole = per.groupBy("countryCode").agg(F.count("*").alias("features"), F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    size = F.coalesce("bytes", F.lit(0)).cast("bigint")
    return whole.join(ranks, "countryCode", "left").join(sizes.select("countryCode", "bytes"), "countryCode", "left").select(
        "countryCode", "features", "vertices", F.coalesce("p50", F.lit(0)).alias("p50"), F.coalesce("p95", F.lit(0)).alias("p95"), "most", size.alias("bytes"),
        F.when(size > WARN_BYTES, "PACKAGE_SIZE_P95_EXCEEDED").alias("warning"), F.when(size > MOST_BYTES, "PACKAGE_TOO_LARGE").alias("failure"),
    )


def audit(features: DataFrame, expected: DataFrame, index: DataFrame, exceptions: DataFrame, sizes: DataFrame) -> DataFrame:
    """V1, V2: (countryCode, code, subject) of everything wrong with the features of all countries; a sound table gives no rows.

    features: see feature_codes; expected: (countryCode, kind, value, minimum, maximum);
    index: (countryCode, areaId); exceptions: (id, kind, a, b); sizes: (countryCode, bytes).
    """
    none = F.lit(None).cast("string").alias("subject")
    counts = features.groupBy(F.col("owner").alias("countryCode")).agg(F.count("*").alias("n")).join(expected, "countryCode", "left")
    invalid = exception_codes(exceptions)
    sound = exceptions.join(invalid.select(F.col("subject").alias("id")), "id", "left_anti")
    large = metrics(features, sizes).where("failure IS NOT NULL").select("countryCode", F.col("failure").alias("code"), none)
    return union_all(
        feature_codes(features), count_codes(counts).select("countryCode", "code", none), index_codes(features, index), geometry_codes(features, sound),
        invalid.select(F.lit(None).cast("string").alias("countryCode"), "code", "subject"), large,
    ).distinct()
