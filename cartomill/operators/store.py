"""Keyed tables as stores (S20, S25): every operation gives the table after it, or rows of it.

A store is a DataFrame with one row a key; what is written is kept by writers or merged
by streaming.merge. Null keys are no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartomill.operators.relational import assert_unique


def get(store: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of these keys, pushed down to the scan as a filter."""
    return store.where(F.col(key).isin(wanted)) if wanted else store.where(F.lit(False))


def listed(store: DataFrame, key: str) -> DataFrame:
    """All rows in the order of their keys: texts as English sorts them, others by value."""
    text = dict(store.dtypes)[key] == "string"
    return store.where(F.col(key).isNotNull()).orderBy(*([F.collate(key, "en")] if text else []), key)


def put(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with these rows in place of those of their keys; a key given twice fails."""
    new = assert_unique(rows.where(F.col(key).isNotNull()), key)
    return store.join(new.select(F.col(key).alias("_new")).distinct(), F.col(key) == F.col("_new"), "left_anti").unionByName(new)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store without these keys; keys it lacks change nothing."""
    return store.join(keys.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")
