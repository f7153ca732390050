"""Processes of an order against their plan."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.calendar import day_calendar
from costurero.sources.registry import Tables


def schedule(tables: Tables, today: datetime | date | str, pedido: int | None = None) -> DataFrame:
    """Planned bar, expected and shown progress, and markers of every process.

    Expected progress is the elapsed share of the planned days, within 0 and 100; it is null
    where nothing is planned (no start, or no days).
    """
    now = F.lit(today).cast("timestamp_ntz")
    orders = P.by_key(tables["Pedido"], "Id_Pedido", pedido)
    steps = tables["Proceso"]
    start, days, done = F.col("Fecha_Inicial_Programada"), F.col("Tiempo"), F.col("Porcentaje_Avance")
    began, ended = F.col("Fecha_Inicial_Real"), F.col("Fecha_Final_Real")
    elapsed = F.floor(S.seconds_between(start, now) / F.lit(86400))
    share = S.ratio(elapsed, days) * 100
    expected = F.when(elapsed < 0, F.lit(0.0)).when(share > 100, F.lit(100.0)).otherwise(share)
    shown = F.when(done.cast("double") < F.col("PCT_ESPERADO"), done.cast("double")).when(
        done.isNotNull(), F.col("PCT_ESPERADO")
    )
    return (
        orders.join(steps, "Id_Pedido")
        .withColumn("PCT_ESPERADO", expected)
        .select(
            "Id_Pedido",
            "Nompedido",
            "Fecha_Emision",
            "Fecha_Entrega",
            "Id_Proceso",
            start.alias("INICIO"),
            (start + F.make_dt_interval(days)).alias("FIN"),
            days.alias("DIAS"),
            done.alias("PCT_REAL"),
            "PCT_ESPERADO",
            (shown / 100).alias("PCT_MOSTRADO"),
            (done > 0).cast("int").alias("INICIADO"),
            F.when(done > 0, began).alias("MARCA_INICIO"),
            F.when(done == 100, ended).alias("MARCA_FIN"),
            F.when(began.isNotNull(), F.concat(done.cast("string"), F.lit("%"))).alias("ETIQUETA_REAL"),
            F.concat(S.whole(F.col("PCT_ESPERADO")).cast("string"), F.lit("%")).alias("ETIQUETA_ESPERADO"),
        )
    )


def schedule_calendar(tables: Tables, pedido: int | None = None) -> DataFrame:
    """The days from issue to delivery of every order, with tick and month marks."""
    orders = P.by_key(tables["Pedido"], "Id_Pedido", pedido)
    return day_calendar(orders, "Id_Pedido", "Fecha_Emision", "Fecha_Entrega")
