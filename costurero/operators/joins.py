"""Joins to master tables and joins that only filter.

No side is marked for broadcast: Spark broadcasts what its own byte threshold or, at run
time, its measured size allows, and otherwise shuffles both sides by the key and splits
partitions that one hot key fills (see ``costurero.session``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.sources.registry import Tables


def with_master(
    df: DataFrame,
    tables: Tables,
    name: str,
    key: str,
    master_key: str | None = None,
    where: Column | None = None,
    **columns: str,
) -> DataFrame:
    """Inner join to the master ``name``, adding ``new="master column"`` for each of ``columns``.

    With no columns the master acts as a filter; matching rows still multiply.
    """
    tag = f"_{name}_key"
    master = tables[name] if where is None else tables[name].where(where)
    master = master.select(
        F.col(master_key or key).alias(tag), *[F.col(old).alias(new) for new, old in columns.items()]
    )
    return df.join(master, F.col(key) == F.col(tag)).drop(tag)


def filter_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with a match in ``other``, once per match."""
    return df.join(other.select(F.col(key).alias("_match")), F.col(key) == F.col("_match")).drop("_match")
