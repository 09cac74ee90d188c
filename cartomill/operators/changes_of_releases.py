"""What a release changes: counts by country, migrations of ids, bindings of its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(before: Column, after: Column) -> Column:
    """Change in per cent of what was before, six decimals; from nothing it is 0 to nothing, else 100."""
    return F.round(F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.abs(after - before) * 100.0 / before), 6)


def report(old: DataFrame, new: DataFrame, key: str, group: str, payload: str, most: float) -> DataFrame:
    """M2, V7: one row a group of two deliveries: before, after, added, deleted, changed, delta, reasons, state.

    Rows of one key are of the group of the new delivery, those deleted of the old one.
    State: ``blocked`` where keys went and the count changed by more than ``most`` per
    cent (a group that is gone counts as deleted and is no such change),
    ``manual-review-required`` where anything else changed, else ``no-review-required``.
    One full join by key; null keys are left out, a null payload equals null.
    """
    side = lambda df, n: df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias(f"g{n}"), F.col(payload).alias(f"p{n}"), F.lit(1).alias(f"in{n}"))
    both = side(old, 0).join(side(new, 1), "k", "full")
    rows = both.select(
        F.explode(F.filter(F.array(
            F.when(F.col("in0") == 1, F.struct(F.col("g0").alias("g"), F.lit(1).alias("before"), F.lit(0).alias("after"), F.lit(0).alias("added"), F.col("in1").isNull().cast("int").alias("deleted"), F.lit(0).alias("changed"))),
            F.when(F.col("in1") == 1, F.struct(F.col("g1").alias("g"), F.lit(0).alias("before"), F.lit(1).alias("after"), F.col("in0").isNull().cast("int").alias("added"), F.lit(0).alias("deleted"), (F.col("in0").isNotNull() & ~F.col("p0").eqNullSafe(F.col("p1"))).cast("int").alias("changed"))),
        ), lambda x: x.isNotNull())).alias("r")
    )
    counts = rows.groupBy(F.col("r.g").alias(group)).agg(*[F.sum(f"r.{c}").alias(c) for c in ("before", "after", "added", "deleted", "changed")])
    told = counts.withColumn("delta", delta(F.col("before"), F.col("after")))
    flags = F.array(
        F.when(F.col("deleted") > 0, "ID_DELETED"), F.when(F.col("added") > 0, "ID_ADDED"), F.when(F.col("changed") > 0, "GEOMETRY_CHANGED"), F.when(F.col("delta") > most, "COUNT_DELTA"),
    )
    blocked = (F.col("deleted") > 0) & (F.col("after") > 0) & (F.col("delta") > most)
    return told.withColumn("reasons", F.filter(flags, lambda x: x.isNotNull())).withColumn(
        "state", F.when(blocked, "blocked").when(F.size("reasons") > 0, "manual-review-required").otherwise("no-review-required")
    )


def migration_types(pairs: DataFrame) -> DataFrame:
    """(old_id, new_id, type) of distinct pairs: 1-1, 1-n (an id parted), n-1 (ids joined), n-n."""
    p = pairs.select("old_id", "new_id").distinct()
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return p.withColumn("_a", n("old_id")).withColumn("_b", n("new_id")).select(
        "old_id", "new_id", F.when((F.col("_a") == 1) & (F.col("_b") == 1), "1-1").when(F.col("_b") == 1, "1-n").when(F.col("_a") == 1, "n-1").otherwise("n-n").alias("type")
    )


def bindings(sides: dict[str, DataFrame], key: str, count: str, equal: list[tuple[str, str]]) -> DataFrame:
    """(key, codes) of every key of any side: ``side:MISSING``, and ``a-b:DIFFERENT`` where two counts differ.

    Each side has one row a key; a null count is compared with none.
    """
    named = [df.select(F.col(key), F.col(count).alias(f"_n_{name}"), F.lit(True).alias(f"_in_{name}")) for name, df in sides.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full"), named)
    missing = [F.when(F.col(f"_in_{name}").isNull(), F.lit(f"{name}:MISSING")) for name in sides]
    other = [F.when(F.col(f"_n_{a}") != F.col(f"_n_{b}"), F.lit(f"{a}-{b}:DIFFERENT")) for a, b in equal]
    return joined.select(key, F.filter(F.array(*missing, *other), lambda x: x.isNotNull()).alias("codes"))
