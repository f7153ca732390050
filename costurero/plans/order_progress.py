"""How far each sales order is: fabric assembled, dyed, dispatched; garments programmed, cut, sewn.

Every stage is reduced to one row per order before it meets the orders. Where two
many-sided tables meet, both are first reduced to one row per join key, one of them
carrying the number of rows it stands for, so duplicates count as often as a plain
join would count them without ever being paired up.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.aggregates import QTY, append_total, masked_sum, totals_table
from costurero.operators.joins import filter_join, with_master
from costurero.plans import constants as K
from costurero.sources.registry import Tables

#: The page variants: date shown, date filtered, whether a delivery date must exist, whether void
#: fabric orders count, whether closed garment orders count, and whether percent columns are added.
VARIANTS: dict[str, dict] = {
    "delivery": dict(shown="dtFechaEntrega", skip_void_fabric=False, open_only=True, status=False),
    "planned": dict(shown="dtFechaPlanea", skip_void_fabric=True, open_only=True, status=False),
    "status": dict(
        shown="dtFechaPlanea", needs="dtFechaEntrega", skip_void_fabric=True, open_only=False, status=True
    ),
}

#: Stands for a missing id where rows are dealt by id.
NO_ID = -(1 << 63)


def only(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """Rows whose ``key`` is among the ids (a frame of one column); all rows if none are given.

    Multiplicities stay. A set of ids that proves small at run time is broadcast by Spark, so
    the rows that do not belong never reach a shuffle.
    """
    if ids is None:
        return df
    return df.join(ids.toDF("_only"), F.col(key) == F.col("_only"), "left_semi")


def keyed(df: DataFrame) -> DataFrame:
    """Each distinct row once, with the number of rows it stands for (``_n``): a set of keys that several facts use.

    Grouped by all its columns and never used without the number, it has one and the same plan below its exchange wherever
    it is used (``ids``), so it runs once: all uses but the first read the exchange of the first.
    """
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n"))


def kept(column: str) -> Column:
    """A column of a ``keyed`` frame as the key of a join.

    The number is always positive. Its part in the value keeps what a join infers of its key, that it is not null, from
    sinking below the exchange, where each use would read other rows than the next.
    """
    return F.when(F.col("_n") > 0, F.col(column))


def ids(keys: DataFrame, column: str) -> DataFrame:
    """One column of a ``keyed`` frame, to join by."""
    return keys.select(kept(column).alias(column))


def each(keys: DataFrame) -> DataFrame:
    """The rows a ``keyed`` frame stands for."""
    return keys.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def fabric_kilos(tables: Tables, skip_void: bool, orders: DataFrame | None = None) -> DataFrame:
    """Kilos required, assembled, dispatched, dyed and approved per garment order.

    Fabric orders meet their dyeing steps, then the items made for them. The result, per fabric
    order and item, meets the order items that ask for it; those also give the required kilos,
    whether or not anything was produced for them. With ``orders`` (ids of garment orders) only
    what hangs on these is read into any grouping.
    """
    asked = keyed(
        only(tables["docOrdenVentaItem"].where(F.col("IdDocumento_Referencia").isNotNull()), "IdDocumento_Referencia", orders)
        .select(
            F.col("IdDocumento_OrdenVenta").alias("_asked_of"),
            F.col("IdmaeItem").alias("_asked_item"),
            F.col("IdDocumento_Referencia").alias("_fabric_for"),
            "dCantidad",
        )
    )
    fabric = P.where_equal(tables["docOrdenProduccion"], bAnulado=0 if skip_void else None)
    if orders is not None:
        # An order is asked of by many items: its id moves once from where they lie.
        fabric = only(fabric, "IdDocumento_Referencia", ids(asked, "_asked_of").distinct())
    steps = tables["docOrdenProduccionRuta"].where(P.positive("IdmaeReceta")).select(
        F.col("IdDocumento_OrdenProduccion").alias("_step_op"), F.col("bCerrado").alias("_step_closed")
    )
    dyed = (
        fabric.join(steps, F.col("IdDocumento_OrdenProduccion") == F.col("_step_op"))
        .groupBy(
            F.col("IdDocumento_OrdenProduccion").alias("_op"),
            F.col("IdDocumento_Referencia").alias("_fabric"),
            "bCerrado",
            "bCierreAprobado",
        )
        .agg(F.count("*").alias("_steps"), F.sum("_step_closed").alias("_steps_closed"))
    )
    made = tables["docOrdenProduccionItem"]
    programmed, required = F.col("dCantidadProgramado"), F.col("dCantidadRequerido")
    steps_n = F.col("_steps")
    kinds = ("_armed", "_sent", "_dyed", "_approved")
    # Summed where the items lie, then dealt by fabric order alone, and so what is asked of it: its items are mostly asked for
    # by the same few orders, whose kilos thus come down to few rows before they move to the orders.
    per_item = (
        made.join(dyed, made["IdDocumento_OrdenProduccion"] == F.col("_op"))
        # There is a step to every row. That the item needs it keeps what the join below infers of it away from the scan.
        .groupBy("_op", "_fabric", F.when(steps_n > 0, F.col("IdmaeItem")).alias("_item"))
        .agg(
            _sum(programmed * steps_n).alias("_armed"),
            masked_sum(F.col("bCerrado"), (required * steps_n).cast(QTY)).cast(QTY).alias("_sent"),
            _sum(programmed * F.col("_steps_closed")).alias("_dyed"),
            masked_sum(F.col("bCierreAprobado"), (programmed * steps_n).cast(QTY)).cast(QTY).alias("_approved"),
        )
        .repartition("_fabric")
        .groupBy("_fabric", "_item")
        .agg(*[_sum(F.col(c)).alias(c) for c in kinds])
    )
    times = F.col("_n")
    # What is asked for is weighed where it lies, by order; only the items and how often they are asked for go to what was made.
    weighed = asked.groupBy("_fabric_for").agg(
        F.sum(F.when(P.positive("_fabric_for"), (F.col("dCantidad") * times).cast(QTY))).cast(QTY).alias("KG")
    )
    items = (
        asked.select(
            kept("_asked_of").alias("_asked_of"), kept("_asked_item").alias("_asked_item"), F.col("_fabric_for").alias("_made_for"), "_n"
        )
        .groupBy("_asked_of", "_asked_item", "_made_for")
        .agg(F.sum("_n").alias("_n"))
    )
    kilos = (
        items.join(per_item, (F.col("_asked_of") == F.col("_fabric")) & (F.col("_asked_item") == F.col("_item")))
        .groupBy("_made_for")
        .agg(
            _sum(F.col("_armed") * times).alias("KG_ARM"),
            _sum(F.col("_sent") * times).alias("KG_PRODUC"),
            _sum(F.col("_dyed") * times).alias("KG_TEÑIDOS"),
            (_sum(F.col("_approved") * times) * F.lit(Decimal(K.APPROVED_SHARE))).alias("KG_APROB_D"),
        )
    )
    return weighed.join(kilos, F.col("_fabric_for") == F.col("_made_for"), "left").drop("_made_for")


def _sum(value: Column) -> Column:
    return F.sum(value.cast(QTY)).cast(QTY)


def moved_units(tables: Tables, ops: DataFrame | None = None) -> DataFrame:
    """Units cut and sewn per production order and item, from the stock notes of both centres.

    With ``ops`` only notes of these production orders, and only their lines, go into the grouping.
    """
    notes = P.where_equal(
        tables["docNotaInventario"],
        IdtdDocumentoForm=K.FORM_STOCK_NOTE,
        bDevolucion=0,
        bDesactivado=0,
        bAnulado=0,
    ).where(P.nonzero("IdDocumento_OrdenProduccion") & F.col("IdmaeCentroCosto").isin(K.CUTTING, K.SEWING))
    notes = with_master(
        only(notes, "IdDocumento_OrdenProduccion", ops),
        tables,
        "maeCentroCosto",
        "IdmaeCentroCosto",
        where=F.col("bConOrdenProduccion") == 1,
    )
    notes = filter_join(notes, tables["docOrdenProduccionRuta"], "IddocOrdenProduccionRuta").select(
        "IdDocumento_NotaInventario", F.col("IdDocumento_OrdenProduccion").alias("_moved_op"), "IdmaeCentroCosto"
    )
    lines = (
        tables["docNotaInventarioItem"]
        .where(P.nonzero("dCantidadIng"))
        .select(
            F.col("IdDocumento_NotaInventario").alias("_note"),
            F.col("IdmaeItem_Inventario").alias("_moved_item"),
            "dCantidadIng",
        )
    )

    def at(centre: int) -> Column:
        return F.sum(F.when(F.col("IdmaeCentroCosto") == centre, F.col("dCantidadIng")))

    moved = (
        notes.join(lines, F.col("IdDocumento_NotaInventario") == F.col("_note"))
        .groupBy("_moved_op", "_moved_item")
        .agg(at(K.CUTTING).alias("_cut"), at(K.SEWING).alias("_sewn"))
    )
    return with_master(
        moved,
        tables,
        "maeItemInventario",
        "_moved_item",
        "IdmaeItem_Inventario",
        where=F.col("IdtdItemForm") == K.ITEM_FORM,
    )


def garment_units(tables: Tables, open_only: bool, orders: DataFrame | None = None) -> DataFrame:
    """Units programmed, cut and sewn per sales order (``_units_for``).

    Items of a production order are reduced to one row each with the number of times they are
    listed; cut and sewn units count once per listing, programmed units once per cutting step.
    Only items, steps and notes of garment production orders, with ``orders`` only of those made
    for these sales orders, go into any grouping.
    """
    production = keyed(
        only(
            P.where_equal(
                tables["docOrdenProduccion"],
                bCerrado=0 if open_only else None,
                bAnulado=0,
                IdtdDocumentoForm=K.FORM_GARMENT_ORDER,
            ).where(F.col("IdDocumento_OrdenProduccion").isNotNull()),
            "IdDocumento_Referencia",
            orders,
        ).select(
            F.col("IdDocumento_OrdenProduccion").alias("_op"), F.col("IdDocumento_Referencia").alias("_units_for")
        )
    )
    ops = ids(production, "_op")
    # A line without either quantity adds nothing. Asking for both keeps both in the exchange of the items, which so is the
    # one that the kilos read, and the items move once for all.
    either = F.col("dCantidadProgramado").isNotNull() | F.col("dCantidadRequerido").isNotNull()
    items = (
        only(tables["docOrdenProduccionItem"], "IdDocumento_OrdenProduccion", ops)
        .groupBy("IdDocumento_OrdenProduccion", "IdmaeItem")
        .agg(F.sum(F.when(either, F.col("dCantidadProgramado"))).alias("_programmed"), F.count("*").alias("_times"))
    )
    times = F.col("_times")
    # The items of an order lie together; what was moved for them comes there, one row per item.
    per_op = (
        items.join(
            moved_units(tables, ops),
            (F.col("IdDocumento_OrdenProduccion") == F.col("_moved_op")) & (F.col("IdmaeItem") == F.col("_moved_item")),
            "left",
        )
        .groupBy(F.col("IdDocumento_OrdenProduccion").alias("_units_op"))
        .agg(
            _sum(F.col("_programmed")).alias("_programmed"),
            _sum(F.col("_cut") * times).alias("_cut"),
            _sum(F.col("_sewn") * times).alias("_sewn"),
        )
    )
    steps = with_master(
        P.where_equal(tables["docOrdenProduccionRuta"], IdmaeCentroCosto=K.CUTTING),
        tables,
        "maeCentroCosto",
        "IdmaeCentroCosto",
        where=F.col("bConOrdenProduccion") == 1,
    ).select(F.col("IdDocumento_OrdenProduccion").alias("_step_op"))
    # A production order meets its few steps before it meets its sums: once per order and count.
    stepped = (
        production.join(steps, F.col("_op") == F.col("_step_op"), "left")
        .groupBy("_op", "_units_for", "_n")
        .agg(F.count("_step_op").alias("_steps"))
    )
    n = F.col("_n")
    return (
        stepped.join(per_op, F.col("_op") == F.col("_units_op"))
        .groupBy("_units_for")
        .agg(
            _sum(F.when(F.col("_steps") > 0, F.col("_programmed") * F.col("_steps") * n)).alias("PROG"),
            _sum(F.col("_cut") * n).alias("CORTADO"),
            _sum(F.col("_sewn") * n).alias("COSIDO"),
        )
    )


def order_progress(
    tables: Tables,
    start: date | str | None = None,
    end: date | str | None = None,
    *,
    variant: str = "planned",
    pedido: str = "",
    pedidos: str | Iterable[str] | None = None,
    cliente: str = "",
    po: str = "",
) -> DataFrame:
    """One row per sales order of the date range (default: this month) with its stage kilos and units.

    ``pedido``, ``cliente`` and ``po`` are contains searches; ``pedidos`` is a list of codes.
    """
    how = VARIANTS[variant]
    start, end = P.or_this_month(start, end)
    searched = P.contains_ci("CoddocOrdenVenta", pedido) & P.in_list("CoddocOrdenVenta", pedidos)
    chosen = P.where_equal(
        tables["docOrdenVenta"], IdtdDocumentoForm=K.FORM_SALES_ORDER, IdtdTipoVenta=K.SALE_TYPE, bAnulado=0
    ).where(
        P.day_range(how["shown"], start, end) & P.contains_ci("nvDocumentoReferencia", po) & searched
    )
    if "needs" in how:
        chosen = chosen.where(F.col(how["needs"]).isNotNull())
    # Only what is shown of dates and names moves.
    issued, shown = F.col("dtFechaEmision"), F.col(how["shown"])
    chosen = with_master(
        chosen.withColumns(
            {"_issued": S.day_of(issued), "_shown": S.day_of(shown), "_days": S.days_between(issued, shown)}
        ),
        tables,
        "maeAnexoCliente",
        "IdmaeAnexo_Cliente",
        where=P.contains_ci("NommaeAnexoCliente", cliente),
        _client="NommaeAnexoCliente",
    ).select(
        F.coalesce("IdDocumento_OrdenVenta", F.lit(NO_ID)).alias("_id"),
        F.col("IdDocumento_OrdenVenta").isNotNull().alias("_has_id"),
        F.col("CoddocOrdenVenta").alias("PEDIDO"),
        "_issued",
        "_shown",
        "_days",
        S.first_chars(F.col("_client")).alias("_client"),
        F.col("nvDocumentoReferencia").alias("PO"),
        F.col("dCantidad").alias("_units"),
    )

    # Dealt by id, so that neither their kilos nor what is asked for them makes them move again.
    chosen = keyed(chosen.repartition("_id"))

    # Units belong to every order with the same code, whatever its form; what is asked of a code goes down to their scan.
    # Each is paired with the chosen orders it counts for, as it stands in the result. Dealt by id, as all that follows asks
    # for them.
    wanted = chosen.select(F.col("_id").alias("_for"), kept("PEDIDO").alias("_code")).distinct()
    same_code = keyed(
        tables["docOrdenVenta"]
        .where(searched)
        .join(wanted, F.col("CoddocOrdenVenta") == F.col("_code"))
        .select(F.col("IdDocumento_OrdenVenta").alias("_same"), "_for", "_code")
        .repartition("_same")
    )
    units = garment_units(tables, how["open_only"], ids(same_code, "_same"))
    # Few numbers go back to the chosen orders, whose texts and kilos stay where they are.
    produced = (
        each(same_code.select("_same", kept("_for").alias("_for"), kept("_code").alias("_code"), "_n"))
        .join(units, F.col("_same") == F.col("_units_for"), "left")
        .select(
            "_for", "_code", *[F.coalesce(F.col(c), F.lit(0).cast(QTY)).alias(c) for c in ("PROG", "CORTADO", "COSIDO")]
        )
    )
    # An order without an id has units by its code, but no kilos.
    own = chosen.withColumn("_own", F.when(F.col("_has_id"), F.col("_id")))
    fabric = fabric_kilos(tables, how["skip_void_fabric"], ids(own, "_own"))
    joined = (
        each(chosen).join(fabric, (F.col("_id") == F.col("_fabric_for")) & F.col("_has_id"), "left")
        .join(produced, (F.col("_id") == F.col("_for")) & (F.col("PEDIDO") == F.col("_code")), "left")
        .withColumn("KG", F.coalesce(F.col("KG"), F.lit(0).cast(QTY)))
    )
    columns = _progress_columns()
    if how["status"]:
        del columns["R1"]
        columns |= _status_columns()
    return joined.select(*[c.alias(name) for name, c in columns.items()])


def _progress_columns() -> dict[str, Column]:
    kg, armed, dyed = F.col("KG"), F.col("KG_ARM"), F.col("KG_TEÑIDOS")
    sent, approved = F.col("KG_PRODUC"), F.col("KG_APROB_D")
    return {
        "PEDIDO": F.col("PEDIDO"),
        "F_EMISION": F.col("_issued"),
        "F_ENTREGA": F.col("_shown"),
        "DIAS": F.col("_days"),
        "CLIENTE": F.col("_client"),
        "PO": F.col("PO"),
        "UNID": S.whole(F.col("_units")),
        "KG_REQ": S.whole(kg),
        "KG_ARM": S.whole(armed),
        "KG_X_ARM": S.whole(_to_assemble()),
        "KG_TEÑIDOS": S.whole(dyed),
        "KG_ARM_X_TEÑIR": S.whole(armed - dyed),
        "KG_DESPACH": S.whole(sent),
        "KG_APROB_D": S.whole(approved),
        "KG_X_DESPACH": S.whole(kg - sent),
        "R": S.ratio(sent, kg) * 100,
        "R1": S.percent_label(S.ratio(armed, kg)),
        "PROG": S.whole(F.col("PROG")),
        "CORTADO": S.whole(F.col("CORTADO")),
        "COSIDO": S.whole(F.col("COSIDO")),
    }


def _to_assemble() -> Column:
    return F.col("KG") * F.lit(Decimal(K.REQUIRED_MARGIN)) - F.col("KG_ARM")


def _status_columns() -> dict[str, Column]:
    """Percent labels, and how much of the programme the fabric at hand allows to cut."""
    kg, units = F.col("KG"), F.col("_units")
    armed, dyed = F.col("KG_ARM"), F.col("KG_TEÑIDOS")
    sent, approved = F.col("KG_PRODUC"), F.col("KG_APROB_D")
    programmed, cut = F.col("PROG"), F.col("CORTADO")
    sent_share, approved_share = S.ratio(sent, kg), S.ratio(approved, kg)
    at_hand = F.greatest(approved_share, sent_share)
    # Rounded before it is cut to whole units, so that 28.999999999999996 counts as 29.
    left_to_cut = F.round(S.cap_at_one(approved_share) * programmed.cast("double") - cut.cast("double"), 6)
    labels = {
        "KG_ARMP": S.ratio(armed, kg),
        "KG_X_ARMP": S.ratio(_to_assemble(), kg),
        "KG_TEÑIDOSP": S.ratio(dyed, kg),
        "KG_ARM_X_TEÑIRP": S.ratio(armed - dyed, kg),
        "KG_DESPACHP": sent_share,
        "KG_APROB_DP": approved_share,
        "KG_X_DESPACHP": S.ratio(kg - sent, kg),
        "PROGP": S.ratio(programmed, units),
        "CORTADOP": S.ratio(cut, units),
        "COSIDOP": S.ratio(F.col("COSIDO"), units),
    }
    return {name: S.percent_label(share) for name, share in labels.items()} | {
        "disp_tela": at_hand,
        "disp_ajuste": S.cap_at_one(at_hand),
        "CORTADO_DEC": cut,
        "puede_cortar": S.cap_at_one(F.least(approved_share, sent_share)) * programmed.cast("double"),
        "con_tela": S.whole(S.floor_at_zero(left_to_cut)),
    }


def sub_list_condition(name: str) -> Column:
    """Which orders a sub-list holds. A null measure means nothing is done yet, so the order
    belongs to the list; only dyeing needs assembled kilos first."""
    return {
        "to_assemble": lambda: P.gt_or_null("KG_X_ARM", 0),
        "to_dye": lambda: P.positive("KG_ARM_X_TEÑIR"),
        "to_dispatch": lambda: P.lt_or_null("R", 97.5),
    }[name]()


def sub_list(progress: DataFrame, name: str, view: str = "kilos", total: bool = True) -> DataFrame:
    """Orders still to assemble, to dye or to dispatch, with or without their grand total."""
    columns = K.LIST_COLUMNS[view][name]
    rows = progress.where(sub_list_condition(name))
    return append_total(rows, columns) if total else rows.select(*columns)


def sub_list_totals(progress: DataFrame, name: str, view: str = "kilos") -> DataFrame:
    """The grand total of a sub-list, alone."""
    return totals_table(progress.where(sub_list_condition(name)), K.LIST_COLUMNS[view][name])


def with_total(progress: DataFrame, variant: str) -> DataFrame:
    """The page's main table with its grand total."""
    return append_total(progress, K.ORDER_COLUMNS[variant])


def order_totals(progress: DataFrame, variant: str = "delivery") -> DataFrame:
    """The grand total of the page's main table, alone."""
    return totals_table(progress, K.ORDER_COLUMNS[variant])


def order_counts(progress: DataFrame) -> DataFrame:
    """Number of orders on the page and on each sub-list, in one pass."""
    return progress.agg(
        F.count("*").alias("PEDIDOS"),
        *[F.count_if(sub_list_condition(n)).alias(n.upper()) for n in ("to_assemble", "to_dye", "to_dispatch")],
    )
