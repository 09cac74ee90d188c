"""What changed between consecutive full snapshots (content-defined chunks).

Every snapshot is cut, in the order of its keys, into chunks at boundary keys: keys
whose hash is below a threshold. Boundaries depend on the keys' content only, so one
added or removed key touches one chunk. The scan digests each chunk of each snapshot
(rows, two 64-bit sums of row digests, hashes of its keys), combined on the map side;
chunks whose digest is that of the neighbouring snapshot are discarded, and only rows
of the others are sent to be joined by key and classified.

Scale: what is shuffled before the join is one digest a chunk and map task with eight
bytes a key, and in the join the narrow rows of unmatched chunks only, by hash of the
key and combined on the map side, so a key that repeats without end is one row a task.
Boundaries are at most about ``CHUNKS``, in proportion to the rows; they and one mask
a chunk are what the driver and the broadcasts hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean rows in a chunk, most chunks, boundaries in one inner list, deliveries compared in one pass.
CHUNK_ROWS, CHUNKS, INNER, SPAN = 64, 65_536, 256, 32


def release_order(release: Column) -> list[Column]:
    """Sort keys of ``YYYY-MM-DD.N``: the date, then N as a number; other forms come first."""
    return [
        F.regexp_extract(release, r"\A(\d{4}-\d{2}-\d{2})\.\d+\z", 1),
        F.regexp_extract(release, r"\.(\d+)\z", 1).try_cast("bigint"),
        release,
    ]


def _count_not_above(key: Column, bounds: list[str]) -> Column:
    """Number of bounds not above key, as a balanced tree of comparisons (JVM side)."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(bounds))


def _with_chunk(df: DataFrame, bounds: list[str]) -> DataFrame:
    """df with ``_chunk``, the number of boundaries not above ``_key``: a tree finds the list, a binary search the place in it."""
    lists = [(0, [])] + [(i + 1, bounds[at : at + INNER]) for i, at in enumerate(range(0, len(bounds), INNER))]
    inner = df.sparkSession.createDataFrame(lists, "_cell int, _inner array<string>")
    steps = F.array(*[F.lit(1 << k) for k in range(INNER.bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.get("_inner", at + n - 1) <= F.col("_key"), at + n).otherwise(at))
    cell = _count_not_above(F.col("_key"), bounds[::INNER])
    # at most CHUNKS / INNER rows of INNER keys
    return df.withColumn("_cell", cell).join(F.broadcast(inner), "_cell").withColumn(
        "_chunk", F.greatest(F.col("_cell") - 1, F.lit(0)) * INNER + place
    ).drop("_cell", "_inner")


def changes(
    df: DataFrame,
    key: str,
    release: str,
    loaded: str,
    values: list[Column],
    chunk_rows: int = CHUNK_ROWS,
    chunks: int = CHUNKS,
    span: int = SPAN,
) -> DataFrame:
    """Rows (release, key, change_kind) for keys that differ from the release before.

    The row of a key with the latest ``loaded`` counts in its release; of several
    with the same ``loaded``, the one with the greatest digest (a fixed choice).
    Null values equal null; null ``loaded`` is the earliest. Rows with a null key or
    release are no records and are left out. A release is compared with the one
    before it that has any row; the first gives no rows. An empty table gives none.
    Columns beside those named are not read, whatever their names. A chunk in which a
    key repeats within a release is never discarded, as its digest would not say which
    row counts.
    """
    rows = _rows(df, key, release, loaded, values)
    # one row per delivery
    sizes = rows.groupBy("_release").count().orderBy(*release_order(F.col("_release"))).collect()
    releases = [r[0] for r in sizes]
    nothing = rows.select(F.col("_release").alias("release"), F.col("_key").alias("key"), F.lit("").alias("change_kind")).where(F.lit(False))
    if len(releases) < 2:
        return nothing
    total = sum(r[1] for r in sizes)
    threshold = int((1 << 30) / max(chunk_rows, total / chunks))
    bounds = sorted(
        r[0] for r in rows.where(F.pmod(F.xxhash64(F.lit(3), F.col("_key")), F.lit(1 << 30)) < threshold).select("_key").distinct().collect()
    )
    passes = [releases[first : first + span + 1] for first in range(0, len(releases) - 1, span)]
    return reduce(DataFrame.unionByName, [_compared(rows.where(F.col("_release").isin(own)), own, bounds) for own in passes])


def _rows(df: DataFrame, key: str, release: str, loaded: str, values: list[Column]) -> DataFrame:
    """Key, release, load time and two digests of the values of every record."""
    names = [f"_v{i}" for i in range(len(values))]
    base = df.select(
        F.col(key).cast("string").alias("_key"), F.col(release).alias("_release"), F.col(loaded).alias("_loaded"), *[v.alias(n) for n, v in zip(names, values)]
    ).where(F.col("_key").isNotNull() & F.col("_release").isNotNull())
    # nulls are skipped by the hash function, so each value goes with its null flag
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    return base.select("_key", "_release", "_loaded", F.xxhash64(F.lit(1), *parts).alias("_d1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("_d2"))


def unmatched_chunks(placed: DataFrame, deliveries: int) -> DataFrame:
    """(_chunk, _mask) of chunks that differ: bit i is set where delivery i is to be compared with i - 1.

    placed: (_chunk, _pos, _key, _d1, _d2). Digests are equal only between deliveries
    in which every key of the chunk stands once.
    """
    row = [F.xxhash64("_key", "_d1", "_d2"), F.xxhash64("_d2", "_key", "_d1")]
    digests = placed.groupBy("_chunk", "_pos").agg(
        F.count("*").alias("n"), F.bit_xor(row[0]).alias("a"), F.bit_xor(row[1]).alias("b"),
        F.size(F.collect_set(F.xxhash64(F.lit(5), "_key"))).alias("keys"),
    )
    by_delivery = digests.groupBy("_chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", F.struct("n", "a", "b", (F.col("n") == F.col("keys")).alias("single"))))).alias("at")
    )  # one entry per delivery

    def bit(i: int) -> Column:
        old, new = (F.try_element_at("at", F.lit(k)) for k in (i - 1, i))
        same = (old.eqNullSafe(new)) & F.coalesce(old["single"], F.lit(True))
        return F.when(same, F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint")

    mask = bit(1)
    for i in range(2, deliveries):
        mask = mask + bit(i)
    return by_delivery.select("_chunk", mask.alias("_mask")).where("_mask <> 0")


def _compared(rows: DataFrame, releases: list[str], bounds: list[str]) -> DataFrame:
    """Changes between neighbours of at most SPAN + 1 deliveries."""
    position = F.create_map(*[x for i, r in enumerate(releases) for x in (F.lit(r), F.lit(i))])
    placed = _with_chunk(rows.withColumn("_pos", position[F.col("_release")]).drop("_release"), bounds)
    # one row a chunk: at most about CHUNKS
    masks = F.broadcast(unmatched_chunks(placed, len(releases)))
    # a delivery is compared with the one before (its own bit) and the one after (the next bit)
    needed = placed.join(masks, "_chunk").where("(_mask & shiftleft(3L, _pos)) <> 0")
    top = lambda i: F.max(F.when(F.col("_pos") == i, F.struct("_loaded", "_d1", "_d2"))).alias(f"_r{i}")
    keyed = needed.groupBy("_key").agg(F.first("_mask").alias("_mask"), *[top(i) for i in range(len(releases))])
    steps = []
    for i in range(1, len(releases)):
        old, new = F.col(f"_r{i - 1}"), F.col(f"_r{i}")
        kind = (
            F.when(old.isNull() & new.isNull(), None).when(old.isNull(), "added").when(new.isNull(), "removed")
            .when((old["_d1"] != new["_d1"]) | (old["_d2"] != new["_d2"]), "changed")
        )
        steps.append(F.struct(F.lit(releases[i]).alias("release"), F.when(F.expr(f"(_mask & {1 << i}L) <> 0"), kind).alias("change_kind")))
    return keyed.select("_key", F.explode(F.filter(F.array(*steps), lambda s: s["change_kind"].isNotNull())).alias("s")).select(
        F.col("s.release").alias("release"), F.col("_key").alias("key"), F.col("s.change_kind").alias("change_kind")
    )


def as_set(col: str) -> Column:
    """An array as a set: distinct, in order, null entries kept once."""
    return F.array_sort(F.array_distinct(F.col(col)))


def area_changes(df: DataFrame) -> DataFrame:
    """Changes of area deliveries; a centroid counts rounded to six decimals."""
    centre = [F.round(F.col(f"centroid.{a}"), 6) + F.lit(0.0) for a in ("x", "y")]
    return changes(
        df,
        "areaId",
        "boundaryRelease",
        "loadedAt",
        [F.col("adminLevel"), F.col("nameZh"), F.col("nameLocal"), as_set("aliases"), F.col("geometryHash"), *centre],
    )


def package_changes(df: DataFrame) -> DataFrame:
    return changes(df, "packageId", "boundaryRelease", "loadedAt", [F.col("boundaryVersion"), F.col("featureCount")])


def found(areas: DataFrame, packages: DataFrame) -> DataFrame:
    """Both kinds in one table: boundary_release, record_kind, record_key, change_kind."""
    out = None
    for kind, df in (("area", area_changes(areas)), ("package", package_changes(packages))):
        part = df.select(
            F.col("release").alias("boundary_release"),
            F.lit(kind).alias("record_kind"),
            F.col("key").alias("record_key"),
            "change_kind",
        )
        out = part if out is None else out.unionByName(part)
    return out
