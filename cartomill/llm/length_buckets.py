"""Filling containers of fixed capacity: optimal length buckets and token-budget batches.

The global histogram of item lengths has at most ``capacity`` bins. Dynamic programming
over it chooses the bucket boundaries that minimise padding (boundary less length, over
all items). Batches then form inside each bucket under the token budget: as many items
of the bucket as the capacity holds. Where a batch leaves budget (an item over half a
container is alone in its batch), it is topped up with whole items of the largest
shorter buckets that fit; ``top_up=False`` leaves batches as their bucket makes them. A
batch is planned once and repeated as often as the counts allow, so the plan has at
most one entry per bucket and batch whatever the number of items.

Scale: token counts are cut to the shared folder once. The driver holds the histogram
and the plan (bounded by capacity and buckets) and takes O(buckets * capacity *
log(capacity)) steps over arrays of O(capacity). Items are ranked inside a bucket over
hash parts, so a bucket with a third of all items is spread; offsets of the parts are
added by a small join, and a rank finds its container by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cartomill import runtime

CAPACITY, BUCKETS, PART_ROWS = 2048, 128, 100_000


def _layer(best: np.ndarray, items: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of one bucket more for every end, and where that bucket starts.

    The padding of a bucket grows with its ends as the quadrangle inequality asks, so
    starts never fall as ends rise: the starts of the ends of one depth of halving lie
    between those of the depth above, and all of one depth are searched together. A
    start beyond its end never gives less than the end itself.
    """
    m = len(lengths)
    line = best + tokens  # padding of i..j is items[j] * L[j] - tokens[j] + line[i] - items[i] * L[j]
    least, at = np.empty(m + 1), np.zeros(m + 1, np.int64)
    least[0] = 0.0
    width = 1 << (m.bit_length() - 1)
    done = np.zeros(m + 2, bool)
    while width:
        ends = np.arange(width, m + 1, 2 * width)
        left, right = ends - width, np.minimum(ends + width, m + 1)
        lo = np.where(left > 0, at[left], 0)
        hi = np.where(done[right], at[np.minimum(right, m)], m)
        hi = np.maximum(np.minimum(hi, ends - 1), lo)
        n = hi - lo + 1
        first = np.cumsum(n) - n
        i = np.arange(n.sum()) - np.repeat(first - lo, n)
        value = line[i] - items[i] * np.repeat(lengths[ends - 1], n)
        low_of = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(low_of, n))
        at[ends] = i[hit[np.searchsorted(hit, first)]]
        least[ends] = low_of + items[ends] * lengths[ends - 1] - tokens[ends]
        done[ends] = True
        width >>= 1
    return least, at


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets of least padding; counts[i] items have length i + 1.

    Every boundary is a length that occurs. Ties go to the bucket that starts lower.
    """
    lengths = (np.nonzero(counts)[0] + 1).astype(float)
    if len(lengths) <= buckets:
        return [int(x) for x in lengths]
    n = counts[lengths.astype(int) - 1].astype(float)
    items, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    m = len(lengths)
    # one bucket from the start, then one more at a time
    best = np.concatenate([[0.0], items[1:] * lengths - tokens[1:]])
    back = [np.zeros(m + 1, np.int32)]
    for _ in range(buckets - 1):
        best, at = _layer(best, items, tokens, lengths)
        back.append(at.astype(np.int32))
    out, j = [], m
    for at in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(at[j])
        if j == 0:
            break
    return sorted(out)


def plan(sizes: list[int], counts: list[int], capacity: int, top_up: bool = True) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {bucket: items}) batches that hold all items; items count as their bucket's size.

    Longest bucket first, each batch is made of its bucket; with top_up, what it leaves
    goes to whole items of shorter buckets, the longest that fit.
    """
    left = dict(enumerate(counts))
    order = [b for b in sorted(left, key=lambda b: -sizes[b]) if left[b]]
    batches = []
    while order:
        own = order[0]
        batch = {own: min(capacity // sizes[own], left[own])}
        room = capacity - batch[own] * sizes[own]
        for b in order[1:] if top_up else ():
            k = min(room // sizes[b], left[b])
            if k:
                batch[b] = k
                room -= k * sizes[b]
        repeats = min(left[b] // k for b, k in batch.items())
        batches.append((repeats, batch))
        for b, k in batch.items():
            left[b] -= k * repeats
        order = [b for b in order if left[b]]
    return batches


def pack(sizes: DataFrame, key: str, length: str, capacity: int = CAPACITY, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """(key, part_no, n_tokens, container_id, start) of every item.

    An item longer than the capacity is split: full parts fill a container each, the
    rest is an item of its own. Items of no or null length take no room: one row with
    0 tokens, null container and start. ``start`` is the item's first position in its
    container; no two items overlap. Equal keys are separate items. An empty table
    gives no rows.
    """
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType
    n = F.coalesce(F.col(length), F.lit(0)).cast("bigint")
    parts = sizes.select(F.col(key).alias("_key"), n.alias("_n")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / F.lit(capacity)) - 1, F.lit(0)).cast("int")))
    ).select(
        "_key", "_part", F.least(F.lit(capacity), F.col("_n") - F.col("_part") * capacity).cast("int").alias("_len")
    )
    histogram = np.zeros(capacity, dtype=np.int64)
    for r in parts.where("_len > 0").groupBy("_len").count().collect():
        histogram[r["_len"] - 1] = r["count"]
    bounds = boundaries(histogram, buckets)
    nothing = parts.where("_len = 0").select(
        F.col("_key").alias(key), F.col("_part").alias("part_no"), F.lit(0).alias("n_tokens"),
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("start"),
    )
    if not bounds:
        return nothing
    bucket_of = np.searchsorted(bounds, np.arange(1, capacity + 1))
    counts = [int(histogram[bucket_of == b].sum()) for b in range(len(bounds))]
    slots, base = [], 0
    seen = [0] * len(bounds)
    for repeats, batch in plan(bounds, counts, capacity, top_up):
        at = 0
        for b, k in batch.items():
            slots.append((b, seen[b], seen[b] + k * repeats, k, base, at, bounds[b]))
            seen[b] += k * repeats
            at += k * bounds[b]
        base += repeats
    split = max(1, -(-int(histogram.sum()) // PART_ROWS))
    items = parts.where("_len > 0").select(
        "_key", "_part", "_len",
        _bucket(F.col("_len"), bounds).alias("_bucket"),
        F.pmod(F.xxhash64("_key", "_part"), F.lit(split)).cast("int").alias("_sub"),
    )
    offsets = items.groupBy("_bucket", "_sub").agg(F.count("*").alias("_m")).select(
        "_bucket", "_sub",
        (F.sum("_m").over(Window.partitionBy("_bucket").orderBy("_sub")) - F.col("_m")).alias("_off"),
    )
    ranked = items.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket", "_sub").orderBy("_key", "_part", "_len")) - 1
    ).join(offsets, ["_bucket", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_off"))
    find = _finder(slots)
    out = ranked.withColumn("_at", find("_bucket", "_rank")).select(
        F.col("_key").cast(kind).alias(key),
        F.col("_part").alias("part_no"),
        F.col("_len").alias("n_tokens"),
        F.col("_at.container_id").alias("container_id"),
        F.col("_at.start").alias("start"),
    )
    return out.unionByName(nothing)


def _bucket(length: Column, bounds: list[int]) -> Column:
    """Number of bounds below a length, as a balanced tree of comparisons."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(length <= bounds[mid], build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(bounds) - 1)


def _finder(slots: list[tuple]):
    """Column function of (bucket, rank) -> (container_id, start), by binary search over the plan's slots.

    slots: (bucket, first rank, rank after the last, items a container, first container,
    position, size), at most one of each bucket and batch: bounded by buckets squared.
    """
    table = np.array(sorted(slots), dtype=np.int64)
    keys = (table[:, 0] << 48) | table[:, 1]

    @arrow_udf(StructType([StructField("container_id", LongType()), StructField("start", IntegerType())]))
    def find(bucket: pa.Array, rank: pa.Array) -> pa.Array:
        b, r = bucket.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        row = table[np.searchsorted(keys, (b << 48) | r, "right") - 1]
        o = r - row[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 4] + o // row[:, 3]), pa.array((row[:, 5] + o % row[:, 3] * row[:, 6]).astype(np.int32))], ["container_id", "start"]
        )

    return find


def fill(sizes: DataFrame, key: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """(top_up, containers, tokens, fill) of both ways of packing; fill is null where nothing is packed."""
    out = None
    for top_up in (False, True):
        packed = pack(sizes, key, length, capacity, top_up=top_up).where("container_id IS NOT NULL")
        # containers are numbered without a gap
        row = packed.agg(F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).select(
            F.lit(top_up).alias("top_up"), "containers", "tokens",
            F.round(F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 6).alias("fill"),
        )
        out = row if out is None else out.unionByName(row)
    return out
