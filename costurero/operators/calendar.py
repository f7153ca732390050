"""Day calendars between two dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_calendar(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row per day from ``start`` to ``end``, marked as second-day tick and as month start.

    The two coarser calendars are subsets of the daily one, so one expansion serves all three.
    An end before the start gives no days.
    """
    day, label = F.col("DIA"), F.col("ETIQUETA_EJE")
    tick = F.pmod(F.date_diff(day, F.col(start)), F.lit(2)) == 0
    month = F.dayofmonth(day) == 1
    return (
        df.where(F.col(end) >= F.col(start))
        .select(key, start, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("DIA"))
        .withColumn("ETIQUETA_EJE", F.date_format(day, "dd_MMM"))
        .select(
            key,
            "DIA",
            tick.cast("int").alias("MARCA_2D"),
            F.when(tick, F.substring(label, 1, 2)).alias("ETIQUETA_DIA"),
            month.cast("int").alias("INICIO_MES"),
            F.when(month, F.substring(label, 4, 3)).alias("ETIQUETA_MES"),
            label,
        )
    )
