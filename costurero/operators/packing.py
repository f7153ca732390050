"""Split a quantity into numbered packages.

A package takes the maximum while that leaves ten or more; otherwise the rest
is one package. In closed form a quantity ``q`` with maximum ``m`` makes ``k``
full packages and one of ``q - k*m``, ``k = max(0, ceil((q - m - 9) / m))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.operators.running import running_before

#: Fixed value: a rest of fewer units than this joins the last package.
MIN_REST = 10

#: Packages that one row expands to at a time, so that no task makes all of a hot order's.
BLOCK = 4096


def full_packages(quantity: Column, max_units: int) -> Column:
    """Number of packages of ``max_units`` before the last one; ``quantity`` is a positive integer."""
    over = quantity - F.lit(max_units + MIN_REST - 1)
    return F.greatest(F.lit(0), F.ceil(over / F.lit(max_units))).cast("bigint")


def split_packages(
    rows: DataFrame, group: str, order: list[str], quantity: str, copies: str, max_units: int
) -> DataFrame:
    """One row per package: ``#`` (running within ``group``), ``UNIDADES``, ``INI``, ``FIN``.

    ``rows`` holds each distinct (group, order..., quantity) once with its number of
    ``copies``; packages before a row are summed in two levels, so a group may have any
    number of them. Each copy starts again at unit 1. A numbered row becomes blocks of
    packages that are spread over the cluster before they expand.
    """
    if max_units < 1:
        raise ValueError("a package holds at least one garment")
    keys = [group, *order, quantity]
    last = F.col("_full") + 1
    counted = (
        rows.where(F.col(quantity) > 0)
        .withColumn("_full", full_packages(F.col(quantity), max_units))
        .withColumn("_total", F.col(copies) * last)
    )
    plan = running_before(counted, [group], [*order, quantity], "_total", "_before").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_total") - 1) / BLOCK)))
    )
    # A given number of partitions: adaptive execution would merge these few rows before they grow.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = plan.repartition(partitions, *keys, "_block")
    first = F.col("_block") * BLOCK
    packages = spread.withColumn(
        "_at", F.explode(F.sequence(first, F.least(F.col("_total"), first + BLOCK) - 1))
    ).withColumn("_i", F.col("_at") % last)
    units = F.when(F.col("_i") < F.col("_full"), F.lit(max_units)).otherwise(
        F.col(quantity) - F.col("_full") * max_units
    )
    start = F.col("_i") * max_units + 1
    return packages.select(
        group,
        *order,
        (F.col("_before") + F.col("_at") + 1).alias("#"),
        units.cast("bigint").alias("UNIDADES"),
        start.cast("bigint").alias("INI"),
        (start + units - 1).cast("bigint").alias("FIN"),
    )
