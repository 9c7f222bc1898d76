"""Plain relational operators: keep the latest, upsert, snapshots, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key by these columns; an aggregate, so each task sends one row a key."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; new must have each key once."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change): added, removed or changed between two listings with unique keys."""
    a = old.select(key, F.struct(*compare).alias("_a"))
    b = new.select(key, F.struct(*compare).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
