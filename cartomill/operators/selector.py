"""Selection of divisions by reviewed rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartomill.operators.relational import assert_unique


@dataclass(frozen=True)
class Selector:
    """Empty lists let everything through; at least one list of subtypes, levels or rules must say something."""

    owners: tuple[str, ...]
    subtypes: tuple[str, ...] = ()
    levels: tuple[int, ...] = ()
    local_types: tuple[tuple[str, ...], ...] = ()
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    columns: dict = field(default_factory=lambda: {"id": "divisionId", "owner": "sourceCountryCode", "subtype": "subtype", "level": "adminLevel", "local": "localType", "land": "isLand"})

    def __post_init__(self):
        if not self.owners:
            raise ValueError("a selector needs an owner")
        if not (self.subtypes or self.levels or self.local_types):
            raise ValueError("a selector needs a positive predicate")


def _in(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


def predicate(s: Selector) -> Column:
    """owned and land and (matches or allowed) and not denied; null never matches a list that is not empty."""
    col = lambda k: F.col(s.columns[k])
    owned = _in(F.upper(col("owner")), [o.upper() for o in s.owners])
    matches = _in(col("subtype"), s.subtypes) & _in(col("level"), s.levels)
    for rule in s.local_types:
        matches = matches & _in(col("local"), rule)
    allowed = _in(col("id"), s.allow) if s.allow else F.lit(False)
    denied = _in(col("id"), s.deny) if s.deny else F.lit(False)
    return owned & F.coalesce(col("land"), F.lit(False)) & (matches | allowed) & ~denied


def select(df: DataFrame, s: Selector) -> DataFrame:
    """Selected rows; a repeated id fails the query, even one that would be left out."""
    return assert_unique(df, s.columns["id"]).where(predicate(s))


def counts(s: Selector) -> list[Column]:
    """Source, selected, excluded, allowlisted (selected by being allowed) and denylisted rows."""
    picked = F.coalesce(predicate(s), F.lit(False))
    listed = lambda ids: _in(F.col(s.columns["id"]), ids) if ids else F.lit(False)
    return [
        F.count("*").alias("source"), F.count_if(picked).alias("selected"), F.count_if(~picked).alias("excluded"),
        F.count_if(picked & listed(s.allow)).alias("allowlisted"), F.count_if(listed(s.deny)).alias("denylisted"),
    ]
