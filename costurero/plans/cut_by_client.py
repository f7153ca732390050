"""Units cut per day and client, with the production orders behind them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.aggregates import sorted_list
from costurero.operators.joins import with_master
from costurero.operators.pivots import pivot_values, unique_names
from costurero.operators.running import running_before
from costurero.plans import constants as K
from costurero.sources.registry import Tables


def cut_orders(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """Units cut per day, client and production order: ``DIA, CLIENTE, OP, UNID``.

    Clients equal in their first 15 characters are one client here. Registration is compared
    as an instant, so of the last day only midnight counts.
    """
    notes = _notes(tables, start, end)
    lines = _lines(tables).select("_note", S.whole(F.col("dCantidadIng")).alias("_units"))
    production = with_master(
        _production(tables).select("_op", F.col("CoddocOrdenProduccion").alias("OP"), "IdmaeAnexo_Cliente"),
        tables, "maeAnexoCliente", "IdmaeAnexo_Cliente", _client="NommaeAnexoCliente",
    )
    of_order = F.col("IdDocumento_OrdenProduccion") == F.col("_op")
    of_note = F.col("IdDocumento_NotaInventario") == F.col("_note")
    day = F.to_date("dtFechaRegistro").alias("DIA")
    if tables.laid_out("docNotaInventario", "dtFechaRegistro"):
        # Notes of few months meet their lines where both lie and move as one row per day and order.
        moved = notes.join(lines, of_note).groupBy(day, "IdDocumento_OrdenProduccion").agg(F.sum("_units").alias("_units"))
        cut = moved.join(production, of_order)
    else:
        # Open orders leave few of the notes before these meet all lines.
        cut = notes.join(production, of_order).join(lines, of_note).withColumn("DIA", day)
    return cut.groupBy("DIA", S.first_chars(F.col("_client")).alias("CLIENTE"), "OP").agg(F.sum("_units").alias("UNID"))


def _notes(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """Cutting notes of the range."""
    return (
        P.where_equal(
            tables.within("docNotaInventario", "dtFechaRegistro", start, end),
            IdtdDocumentoForm=K.FORM_STOCK_NOTE,
            IdmaeCentroCosto=K.CUTTING,
            bDevolucion=0,
            bDesactivado=0,
            bAnulado=0,
        )
        .where(P.nonzero("IdDocumento_OrdenProduccion") & P.instant_range("dtFechaRegistro", start, end))
        .select("IdDocumento_NotaInventario", "IdDocumento_OrdenProduccion", "dtFechaRegistro")
    )


def _production(tables: Tables) -> DataFrame:
    """Open garment production orders."""
    return P.where_equal(
        tables["docOrdenProduccion"], bCerrado=0, bAnulado=0, IdtdDocumentoForm=K.FORM_GARMENT_ORDER
    ).withColumnRenamed("IdDocumento_OrdenProduccion", "_op")


def _lines(tables: Tables) -> DataFrame:
    """Lines of stock notes that move something."""
    return (
        tables["docNotaInventarioItem"]
        .where(P.nonzero("dCantidadIng"))
        .withColumnRenamed("IdDocumento_NotaInventario", "_note")
    )


def client_names(tables: Tables, start: date | str, end: date | str) -> list[str]:
    """The clients that have a column in the report of the range, from keys alone.

    Notes that move something lead to production orders, these to client ids, and only the distinct ids meet
    the clients' names: no unit is summed and no document's text is read.
    """
    moved = _notes(tables, start, end).join(
        _lines(tables).select("_note"), F.col("IdDocumento_NotaInventario") == F.col("_note"), "left_semi"
    )
    ids = (
        _production(tables)
        .join(moved.select(F.col("IdDocumento_OrdenProduccion").alias("_moved")), F.col("_op") == F.col("_moved"), "left_semi")
        .select("IdmaeAnexo_Cliente")
        .distinct()
    )
    named = with_master(ids, tables, "maeAnexoCliente", "IdmaeAnexo_Cliente", _client="NommaeAnexoCliente")
    return pivot_values(named.select(S.first_chars(F.col("_client")).alias("CLIENTE")), "CLIENTE")


def cut_by_client_report(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """``cut_by_client`` over the cells of the range, its columns named by ``client_names``."""
    return cut_by_client(op_lists(cut_orders(tables, start, end)), client_names(tables, start, end))


def op_lists(orders: DataFrame) -> DataFrame:
    """Units and production-order list per day and client: one row per cell of the report.

    ``orders`` already has each production order once per cell, so a list is as long as the
    text it becomes.
    """
    return orders.groupBy("DIA", "CLIENTE").agg(F.sum("UNID").alias("UNID"), sorted_list("OP").alias("OPS"))


def op_list_pages(orders: DataFrame, size: int = 1000) -> DataFrame:
    """The production-order list of each day and client as numbered pages: ``DIA, CLIENTE, PAGINA, OPS``.

    A page holds ``size`` orders, the last one what is left; its pages, joined in order, are the cell's list in
    ``op_lists``. Orders are counted through in two levels, so no task holds a whole cell. A cell without any order's
    code has no page.
    """
    if size < 1:
        raise ValueError("a page holds at least one order")
    coded = orders.where(F.col("OP").isNotNull()).select("DIA", "CLIENTE", "OP", F.lit(1).cast("bigint").alias("_one"))
    counted = running_before(coded, ["DIA", "CLIENTE"], ["OP"], "_one", "_before")
    page = (F.floor(F.col("_before") / size) + 1).alias("PAGINA")
    return counted.groupBy("DIA", "CLIENTE", page).agg(sorted_list("OP").alias("OPS"))


def cut_by_client(cells: DataFrame, clients: list[str] | None = None) -> DataFrame:
    """A row per day; per client its units and ``<client>_OP`` list, and their ``TOTAL``.

    ``cells`` has each day and client once (``op_lists``). Absent cells are 0 and empty text; cuts without a
    client name belong to no column. Without cells the result is empty with ``FECHA, TOTAL``. Without a list
    of ``clients`` one job reads their names. Names equal but for case, or equal to another column, are
    numbered (``unique_names``).
    """
    if clients is None:
        clients = pivot_values(cells, "CLIENTE")
    own = F.col("CLIENTE").isNotNull() if not clients else F.col("CLIENTE").isin(clients)
    by_day = cells.groupBy("DIA").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("CLIENTE").isNotNull(), F.struct("CLIENTE", F.struct("UNID", "OPS"))))
        ).alias("_cells"),
        F.coalesce(F.sum(F.when(own, F.col("UNID"))), F.lit(0)).alias("_total"),
    )
    found = F.col("_cells")
    columns = [
        S.day_text(F.col("DIA")).alias("_d"),
        *[F.coalesce(F.try_element_at(found, F.lit(c))["UNID"], F.lit(0)).alias(f"_u{i}") for i, c in enumerate(clients)],
        F.col("_total"),
        *[F.coalesce(F.try_element_at(found, F.lit(c))["OPS"], F.lit("")).alias(f"_o{i}") for i, c in enumerate(clients)],
    ]
    names = unique_names([*clients, *[f"{c}_OP" for c in clients]], ["FECHA", "TOTAL"])
    n = len(clients)
    return by_day.orderBy("DIA").select(*columns).toDF("FECHA", *names[:n], "TOTAL", *names[n:])


def cut_by_client_kpis(orders: DataFrame) -> DataFrame:
    """Days with cuts, units, and units per such day (0 when there is none)."""
    named = F.when(F.col("CLIENTE").isNotNull(), F.col("UNID"))
    by_day = orders.groupBy("DIA").agg(F.sum(named).alias("_units"))
    total = by_day.agg(
        F.count("*").alias("DIAS"), F.coalesce(F.sum("_units"), F.lit(0)).alias("UNIDADES")
    )
    return total.withColumn(
        "PROMEDIO", F.coalesce(S.ratio(F.col("UNIDADES"), F.col("DIAS")), F.lit(0.0))
    )
