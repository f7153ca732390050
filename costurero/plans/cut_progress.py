"""Cutting progress per production order and combo."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.joins import filter_join, with_master
from costurero.plans import constants as K
from costurero.plans.process_matrix import production_orders
from costurero.sources.registry import Tables


def cut_progress(
    tables: Tables,
    start: date | str | None = None,
    end: date | str | None = None,
    *,
    pedidos: str | Iterable[str] | None = None,
    cliente: str | None = None,
) -> DataFrame:
    """Required, programmed, produced and pending units of orders planned in the range (default: this month).

    The planned date is compared as an instant. The orders of the range are joined to their
    production orders before the progress rows are.
    """
    start, end = P.or_this_month(start, end)
    orders = tables["docOrdenVenta"].where(
        P.instant_range("dtFechaPlanea", start, end) & P.in_list("CoddocOrdenVenta", pedidos)
    )
    ops = production_orders(tables, orders, tables["docOrdenProduccion"]).where(P.contains_ci_opt("_client", cliente))
    cutting = P.where_equal(tables["avanceCombo"], IdmaeCentroCosto=K.CUTTING)
    cutting = with_master(cutting, tables, "maeCentroCosto", "IdmaeCentroCosto", PROCESO="NommaeCentroCosto")
    cutting = with_master(cutting, tables, "maeCombo", "IdmaeCombo", COMBO="NommaeCombo")
    found = cutting.join(ops, F.col("IdDocumento_OrdenProduccion") == F.col("_op"))
    found = filter_join(found, tables["docOrdenProduccionRuta"], "IddocOrdenProduccionRuta")
    required, programmed = F.col("dCantidadRequerido"), F.col("dCantidadProgramado")
    produced = F.col("dCantidadProducido")
    return found.select(
        "OP",
        "PROCESO",
        "COMBO",
        S.day_month(F.col("_due")).alias("F_ENTREGA"),
        S.first_chars(F.col("_client")).alias("CLIENTE"),
        "PEDIDO",
        S.day_month(F.col("dtFechaPlanea")).alias("F_PLAN"),
        S.first_chars(F.col("_style")).alias("ESTILO"),
        required.alias("REQUERI"),
        programmed.alias("PROG"),
        produced.alias("PRODUC"),
        (programmed - produced).alias("PENDIENTE"),
        S.percent_text(S.guarded_ratio(programmed, produced, required)).alias("PORCENT"),
    )


def cut_progress_kpis(progress: DataFrame) -> DataFrame:
    """Rows, required, produced and pending units in one row."""
    return progress.agg(
        F.count("*").alias("REGISTROS"),
        F.sum("REQUERI").alias("TOTAL_REQUERIDO"),
        F.sum("PRODUC").alias("TOTAL_PRODUCIDO"),
        F.sum("PENDIENTE").alias("TOTAL_PENDIENTE"),
    )
