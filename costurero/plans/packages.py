"""Packages of a service order: lines from work and purchase orders, split and numbered.

The order documents are joined to their production order, sales order and client first;
the far more numerous lines then meet them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.joins import with_master
from costurero.operators.latest import last_by_numbers
from costurero.operators.packing import split_packages
from costurero.plans import constants as K
from costurero.sources.registry import Tables

_KINDS = {
    # kind: (head table, code, line table, material table, key)
    "T": ("docOrdenTrabajo", "CoddocOrdenTrabajo", "docOrdenTrabajoProduccion", "docOrdentrabajoItem",
          "IdDocumento_OrdenTrabajo"),
    "C": ("docOrdenCompra", "CoddocOrdenCompra", "docOrdenCompraProduccion", "docOrdenCompraItem",
          "IdDocumento_OrdenCompra"),
}


def heads(
    tables: Tables, os: str | None = None, reduced: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Cutting service orders with the documents they refer to.

    Once per raw material; or, given a way to reduce the materials ``(_material_of, MP)`` to one row
    per order, once per order, so that an order of many materials goes on as one row.
    """
    parts = []
    for kind, (head, code, _, used, key) in _KINDS.items():
        orders = P.by_key(P.where_equal(tables[head], IdmaeCentroCosto=K.CUTTING), code, os)
        materials = tables[used].select(
            F.col(key).alias("_material_of"), S.last_chars(F.col("ntDescripcion")).alias("MP")
        )
        if reduced is not None:
            materials = reduced(materials)
        parts.append(
            orders.join(materials, F.col(key) == F.col("_material_of")).select(
                F.lit(kind).alias("_kind"),
                F.col(key).alias("_id"),
                F.col(code).alias("OS"),
                F.col("IdDocumento_Referencia").alias("_op_ref"),
                F.col("ntObservacion").alias("OBS"),
                "MP",
            )
        )
    production = tables["docOrdenProduccion"].select(
        F.col("IdDocumento_OrdenProduccion").alias("_op"),
        F.col("CoddocOrdenProduccion").alias("OP"),
        F.col("IdDocumento_Referencia").alias("_order_ref"),
    )
    sales = tables["docOrdenVenta"].select(
        F.col("IdDocumento_OrdenVenta").alias("_order"),
        F.col("CoddocOrdenVenta").alias("PEDIDO"),
        F.col("nvDocumentoReferencia").alias("PO"),
        "IdmaeAnexo_Cliente",
    )
    full = (
        parts[0]
        .unionByName(parts[1])
        .join(production, F.col("_op_ref") == F.col("_op"))
        .join(sales, F.col("_order_ref") == F.col("_order"))
    )
    full = with_master(full, tables, "maeAnexoCliente", "IdmaeAnexo_Cliente", CLIENTE="NommaeAnexoCliente")
    return full.select("_kind", "_id", "OS", "PEDIDO", "CLIENTE", "PO", "OP", "OBS", "MP")


def _counted_lines(tables: Tables) -> DataFrame:
    """Lines of both kinds of order with the ids of item and combo and their size."""
    parts = [
        tables[line].select(
            F.lit(kind).alias("_line_kind"),
            F.col(key).alias("_line_id"),
            F.col("IdmaeItem").alias("_item"),
            F.col("idmaecombo").alias("_combo"),
            "IdmaeTalla",
            F.col("dCantidad").alias("CANTIDAD"),
        )
        for kind, (_, _, line, _, key) in _KINDS.items()
    ]
    return with_master(
        parts[0].unionByName(parts[1]), tables, "maeTalla", "IdmaeTalla", TALLA="NommaeTalla", ORDEN_TALLA="iSecuencia"
    )


def _named(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows with the names of their combo and style; those whose ids the masters do not have are left out."""
    rows = with_master(rows, tables, "maeCombo", "_combo", "IdmaeCombo", COMBO="NommaeCombo")
    rows = with_master(
        rows, tables, "maeItemInventario", "_item", "IdmaeItem_Inventario", IdmaeEstilo="IdmaeEstilo"
    )
    return with_master(rows, tables, "maeEstilo", "IdmaeEstilo", ESTILO="NommaeEstilo")


def lines(tables: Tables) -> DataFrame:
    """Lines of both kinds of order with style, combo and size."""
    return _named(_counted_lines(tables), tables)


def _meet(rows: DataFrame, orders: DataFrame) -> DataFrame:
    return rows.join(orders, (F.col("_line_kind") == F.col("_kind")) & (F.col("_line_id") == F.col("_id")))


def package_source(tables: Tables, os: str | None = None) -> DataFrame:
    """Every line of one service order, or of all, with its full heading."""
    return _meet(lines(tables), heads(tables, os)).select(
        "PEDIDO", "CLIENTE", "PO", "OP", "OS", "ESTILO", "COMBO", "OBS", "MP", "TALLA", "ORDEN_TALLA", "CANTIDAD"
    )


def _number_of_materials(materials: DataFrame) -> DataFrame:
    return materials.groupBy("_material_of").agg(F.count("*").alias("MP"))


def size_quantities(tables: Tables, os: str | None = None) -> DataFrame:
    """Each distinct size and whole quantity of a service order with its number of lines.

    A line repeats once per raw material of its order. Only these counts go on, so an order
    of any number of lines stays a few rows.
    """
    counted = heads(tables, os, _number_of_materials).groupBy("_kind", "_id", "OS").agg(F.sum("MP").alias("_times"))
    return (
        _meet(lines(tables), counted)
        .groupBy("OS", "ORDEN_TALLA", F.trim("TALLA").alias("TALLA"), S.whole(F.col("CANTIDAD")).alias("_units"))
        .agg(F.sum("_times").alias("_lines"))
        .where(F.col("_units") > 0)
    )


def packages(tables: Tables, max_units: int, os: str | None = None) -> DataFrame:
    """Numbered packages per service order: ``OS, #, TALLA, CANTIDAD, Prenda Ini, Prenda Fin``.

    Sizes follow their sequence; within a size smaller quantities come first.
    """
    split = split_packages(
        size_quantities(tables, os), "OS", ["ORDEN_TALLA", "TALLA"], "_units", "_lines", max_units
    )
    return split.select(
        "OS",
        "#",
        "TALLA",
        F.col("UNIDADES").alias("CANTIDAD"),
        F.col("INI").alias("Prenda Ini"),
        F.col("FIN").alias("Prenda Fin"),
    )


def packages_by_size(tables: Tables, os: str | None = None) -> DataFrame:
    """Units per service order and size. Splitting keeps units, so no package is made for it."""
    return (
        size_quantities(tables, os)
        .groupBy("OS", "TALLA")
        .agg(F.sum(F.col("_units") * F.col("_lines")).alias("CANTIDAD"))
    )


_HEADER = ["PEDIDO", "CLIENTE", "PO", "OP", "ESTILO", "COMBO", "OBS", "MP"]


def _last_material(materials: DataFrame) -> DataFrame:
    """The greatest text of each order; all but the first of a task's rows go before they move."""
    by_text = W.partitionBy("_material_of").orderBy(F.desc("MP"))
    return materials.withColumn("_nth", F.row_number().over(by_text)).where("_nth = 1").drop("_nth")


def packages_header(tables: Tables, os: str | None = None) -> DataFrame:
    """The heading of each service order: that of its last line, by size, item and combo.

    Lines are reduced by their numbers alone to the last one of each order. Only these meet the headings and the names of
    style and combo; texts decide between headings whose last lines are equal.
    """
    known = [
        tables["maeCombo"].select(F.col("IdmaeCombo").alias("_combo")),
        tables["maeItemInventario"]
        .join(tables["maeEstilo"], "IdmaeEstilo", "left_semi")
        .select(F.col("IdmaeItem_Inventario").alias("_item")),
    ]
    counted = _counted_lines(tables)
    for ids in known:
        counted = counted.join(ids, ids.columns, "left_semi")
    number = ["ORDEN_TALLA", "_item", "_combo"]
    last_lines = last_by_numbers(counted, ["_line_kind", "_line_id"], *number)
    rows = _named(_meet(last_lines, heads(tables, os, _last_material)), tables)
    last = W.partitionBy("OS").orderBy(*[F.desc(c) for c in [*number, *_HEADER]])
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select("OS", *_HEADER)
