"""Joins, set operations and checks that other operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; null keys count as one key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows; a repeated key fails the query that reads them (one shuffle by key)."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(
        F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(True)
    ).drop("_n")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def set_difference(left: DataFrame, right: DataFrame, key: str, missing: str = "missing", extra: str = "extra") -> DataFrame:
    """(key, code) of keys on one side only; null keys match nothing and are left out."""
    a, b = (x.select(key).where(F.col(key).isNotNull()).distinct() for x in (left, right))
    return (
        a.join(b, key, "left_anti").withColumn("code", F.lit(missing))
        .unionByName(b.join(a, key, "left_anti").withColumn("code", F.lit(extra)))
    )


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) where rows of one key differ; null equals null."""
    pairs = left.select(key, F.struct(*columns).alias("_l")).join(right.select(key, F.struct(*columns).alias("_r")), key)
    flags = F.filter(
        F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()
    )
    return pairs.select(key, F.explode(flags).alias("column"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def replace_part(df: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one value replaced by new ones; rows with a null stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def last_writer_wins(current: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, replace: bool = False) -> DataFrame:
    """Incoming rows win only if their stamp is strictly later; a key that is new is added.

    With replace the current rows are dropped first. Of several incoming rows of a key
    the latest counts; among equal stamps current before incoming; null stamps are earliest.
    """
    if replace:
        return first_by(incoming, keys, F.col(stamp).desc_nulls_last())
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return first_by(both, keys, F.col(stamp).desc_nulls_last(), F.col("_side")).drop("_side")


def positions(ordered: DataFrame) -> DataFrame:
    """A sorted table with ``position`` from 1: the order itself as a column.

    Ranges are sorted apart and offset by the rows before them (two passes), so that no
    task holds all rows.
    """
    schema = ordered.schema
    spark = ordered.sparkSession
    numbered = ordered.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    return spark.createDataFrame(numbered, StructType([*schema.fields, StructField("position", LongType(), False)]))


def unknown_references(df: DataFrame, known: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code) of references that the other table lacks, each once; null is no reference."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti").withColumn("code", F.lit(code))


def owner_of(df: DataFrame, owner: str, codes: str) -> DataFrame:
    """(code, owner, contested) of every code of the arrays; one that several owners name has none."""
    pairs = df.select(F.col(owner).alias("owner"), F.explode(codes).alias("code")).where("code IS NOT NULL").distinct()
    n = F.count("owner")
    return pairs.groupBy("code").agg(F.when(n == 1, F.min("owner")).alias("owner"), (n > 1).alias("contested"))


def owned(df: DataFrame, key: str, owners: DataFrame, owner: str, excluded: list[str]) -> DataFrame:
    """(key, owner, code): the owner of each id; EXCLUDED for those named, UNOWNED for the rest without one."""
    named = F.coalesce(F.col(key).isin(excluded), F.lit(False)) if excluded else F.lit(False)
    joined = df.select(key).distinct().join(owners.select(F.col(owner).alias("owner")).distinct(), (F.col(key) == F.col("owner")) & ~named, "left")
    return joined.select(key, "owner", F.when(named, "EXCLUDED").when(F.col("owner").isNull(), "UNOWNED").alias("code"))


def equal_sets(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """(group, same): whether a group has the same set of keys on both sides; groups and keys that are null are left out.

    Keys are joined, not collected, so that a group may be of any size.
    """
    side = lambda df, name: df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, key).distinct().withColumn(name, F.lit(True))
    both = side(left, "_a").join(side(right, "_b"), [group, key], "full")
    return both.groupBy(group).agg(F.every(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same"))


def cache_status(wanted: DataFrame, kept: DataFrame, key: str, columns: list[str], loads: Column) -> DataFrame:
    """(key, status) of entries against the kept copies.

    ``cached`` where all columns are equal (null equals null), else ``fresh`` if the entry
    ``loads``, ``stale-cache`` if it does not and a copy is kept, ``unavailable`` otherwise.
    """
    old = kept.select(key, F.struct(*columns).alias("_kept"))
    status = (
        F.when(F.col("_kept").isNotNull() & F.struct(*columns).eqNullSafe(F.col("_kept")), "cached").when(loads, "fresh")
        .when(F.col("_kept").isNotNull(), "stale-cache").otherwise("unavailable")
    )
    return wanted.join(old, key, "left").select(key, status.alias("status"))
