"""Required and produced quantity per production order, combo and process."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.joins import filter_join, with_master
from costurero.operators.pivots import column, pivot_sums, pivot_values
from costurero.sources.registry import Tables

INDEX = ["PEDIDO", "OP", "CLIENTE", "ESTILO", "COMBO"]
MEASURES = {"Q_REQ": "{} (Req)", "Q_PROD": "{} (Prod)"}


def production_orders(tables: Tables, orders: DataFrame, production: DataFrame) -> DataFrame:
    """Production orders with their sales order, style and client, one row per match."""
    sales = orders.select(
        F.col("IdDocumento_OrdenVenta").alias("_order"), F.col("CoddocOrdenVenta").alias("PEDIDO"), "dtFechaPlanea"
    )
    ops = production.select(
        F.col("IdDocumento_OrdenProduccion").alias("_op"),
        F.col("CoddocOrdenProduccion").alias("OP"),
        F.col("IdDocumento_Referencia").alias("_ref"),
        F.col("dtFechaEntrega").alias("_due"),
        "IdmaeEstilo",
        "IdmaeAnexo_Cliente",
    )
    ops = with_master(ops, tables, "maeEstilo", "IdmaeEstilo", _style="nvModelo")
    ops = with_master(ops, tables, "maeAnexoCliente", "IdmaeAnexo_Cliente", _client="NommaeAnexoCliente")
    return ops.join(sales, F.col("_ref") == F.col("_order"))


def process_summary(tables: Tables, delivered_after: date | str = "2024-07-30") -> DataFrame:
    """Quantities per order, production order, process, combo, client and style.

    Only progress of the production orders of the date goes into the first grouping, which sums
    the sizes away before the rows meet any document. Groups use the full client name; the result
    shows its first 15 characters.
    """
    ops = _dated(tables, delivered_after)
    sized = with_master(_progress(tables, ops), tables, "maeTalla", "IdmaeTalla")
    by_step = sized.groupBy(
        "IdDocumento_OrdenProduccion", "IddocOrdenProduccionRuta", "IdmaeCentroCosto", "IdmaeCombo"
    ).agg(
        F.sum("dCantidadRequerido").alias("_req"),
        F.sum("dCantidadProgramado").alias("_prog"),
        F.sum("dCantidadProducido").alias("_prod"),
        F.sum(F.col("dCantidadProgramado") - F.col("dCantidadProducido")).alias("_pend"),
    )
    named = with_master(by_step, tables, "maeCentroCosto", "IdmaeCentroCosto", PROCESO="NommaeCentroCosto")
    named = with_master(named, tables, "maeCombo", "IdmaeCombo", COMBO="NommaeCombo")
    routed = filter_join(named, tables["docOrdenProduccionRuta"], "IddocOrdenProduccionRuta")
    return (
        routed.join(ops, F.col("IdDocumento_OrdenProduccion") == F.col("_op"))
        .groupBy("PEDIDO", "OP", "PROCESO", "COMBO", "_client", F.col("_style").alias("ESTILO"))
        .agg(
            F.sum("_req").alias("Q_REQ"),
            F.sum("_prog").alias("Q_PROG"),
            F.sum("_prod").alias("Q_PROD"),
            F.sum("_pend").alias("Q_PEND"),
        )
        .select(
            "PEDIDO",
            "OP",
            "PROCESO",
            "COMBO",
            S.first_chars(F.col("_client")).alias("CLIENTE"),
            "ESTILO",
            "Q_REQ",
            "Q_PROG",
            "Q_PROD",
            "Q_PEND",
            S.guarded_ratio(F.col("Q_PROG"), F.col("Q_PROD"), F.col("Q_REQ")).alias("AVANCE_PORC"),
        )
    )


def _dated(tables: Tables, delivered_after: date | str) -> DataFrame:
    return production_orders(
        tables,
        tables["docOrdenVenta"],
        tables["docOrdenProduccion"].where(P.after("dtFechaEntrega", delivered_after)),
    )


def _progress(tables: Tables, ops: DataFrame) -> DataFrame:
    """Progress of the production orders among ``ops``."""
    dated = ops.select(F.col("_op").alias("_dated")).distinct()
    return tables["avanceComboTalla"].join(dated, F.col("IdDocumento_OrdenProduccion") == F.col("_dated"), "left_semi")


def process_names(
    tables: Tables,
    delivered_after: date | str = "2024-07-30",
    cliente: str | None = None,
    pedidos: Iterable[str] = (),
    ops: Iterable[str] = (),
) -> list[str]:
    """The processes that have columns in the matrix of these choices, from keys alone.

    A progress row counts if its order, size, combo and step exist and the matrix would keep its keys; only the
    distinct work centres meet their names. No quantity is read, nothing is summed.
    """
    chosen = _dated(tables, delivered_after).withColumn("CLIENTE", S.first_chars(F.col("_client")))
    chosen = P.cascade(chosen, cliente, pedidos, ops).dropna(subset=["PEDIDO", "OP", "CLIENTE", "_style"])
    rows = _progress(tables, chosen)
    combos = tables["maeCombo"].where(F.col("NommaeCombo").isNotNull())
    for key, other in (
        ("IdmaeTalla", tables["maeTalla"]), ("IdmaeCombo", combos), ("IddocOrdenProduccionRuta", tables["docOrdenProduccionRuta"])
    ):
        rows = rows.join(other.select(F.col(key).alias("_found")), F.col(key) == F.col("_found"), "left_semi")
    centres = rows.select("IdmaeCentroCosto").distinct()
    return pivot_values(with_master(centres, tables, "maeCentroCosto", "IdmaeCentroCosto", PROCESO="NommaeCentroCosto"), "PROCESO")


def process_report(
    tables: Tables,
    delivered_after: date | str = "2024-07-30",
    cliente: str | None = None,
    pedidos: Iterable[str] = (),
    ops: Iterable[str] = (),
) -> DataFrame:
    """The matrix of these choices, its columns named by ``process_names``."""
    pedidos, ops = list(pedidos), list(ops)
    names = process_names(tables, delivered_after, cliente, pedidos, ops)
    return process_matrix(P.cascade(process_summary(tables, delivered_after), cliente, pedidos, ops), names)


def process_matrix(summary: DataFrame, processes: list[str] | None = None) -> DataFrame:
    """Processes as columns, required and produced side by side.

    Without a list of ``processes`` one job reads their names; the matrix itself stays lazy.
    """
    if processes is None:
        processes = pivot_values(summary, "PROCESO")
    return pivot_sums(summary, INDEX, "PROCESO", processes, MEASURES)


def presentation(matrix: DataFrame) -> DataFrame:
    """The matrix as shown: quantities as text with thousands separators."""
    return matrix.select(*INDEX, *[S.thousands(column(c)).alias(c) for c in matrix.columns if c not in INDEX])
