"""Percent histograms of several columns at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percent_histogram(df: DataFrame, metrics: Mapping[str, str], bins: int = 30) -> DataFrame:
    """``METRIC, BIN, DESDE, HASTA, N, PORCENTAJE``: equal bins between each column's extremes.

    ``metrics`` maps a label to a column. Nulls do not count; a constant column spans
    half a unit to either side; a column without values gives no rows. A value belongs
    to the bin whose edges, as floats, enclose it; the last bin includes its upper edge.
    """
    wide = df.select(*[F.col(c).cast("double").alias(label) for label, c in metrics.items()])
    values = wide.unpivot([], list(metrics), "METRIC", "_x").where(F.col("_x").isNotNull())
    constant = F.col("_min") == F.col("_max")
    # All columns' extremes in one row, before anything is unpivoted; then one row per metric,
    # whatever the data: the only thing broadcast here.
    extremes = [
        F.struct(F.lit(m).alias("METRIC"), F.min(m).alias("_min"), F.max(m).alias("_max"), F.count(m).alias("_total"))
        for m in metrics
    ]
    bounds = (
        wide.agg(F.array(*extremes).alias("_all"))
        .select(F.inline("_all"))
        .where(F.col("_total") > 0)
        .select(
            "METRIC",
            "_total",
            F.when(constant, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
            F.when(constant, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
        )
        .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    )

    def edge(i):
        return F.when(i == bins, F.col("_hi")).otherwise(i * F.col("_step") + F.col("_lo"))

    guess = F.least(
        F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)
    ).cast("int")
    i = F.col("_guess")
    placed = (
        F.when(F.col("_x") < edge(i), i - 1)
        .when((F.col("_x") >= edge(i + 1)) & (i != bins - 1), i + 1)
        .otherwise(i)
    )
    # A metric's counts, at most one per bin, meet again in one row, which then gives every bin.
    counts = (
        values.join(F.broadcast(bounds), "METRIC")
        .withColumn("_guess", guess)
        .groupBy("METRIC", "_total", "_lo", "_hi", "_step", placed.alias("_bin"))
        .agg(F.count("*").alias("_n"))
        .groupBy("METRIC", "_total", "_lo", "_hi", "_step")
        .agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"))
        .withColumn("BIN", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    b = F.col("BIN")
    n = F.coalesce(F.try_element_at("_counts", b), F.lit(0))
    return counts.select(
        "METRIC",
        "BIN",
        edge(b).alias("DESDE"),
        edge(b + 1).alias("HASTA"),
        n.alias("N"),
        (n.cast("double") / F.col("_total").cast("double") * 100).alias("PORCENTAJE"),
    )
