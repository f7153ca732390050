"""Report rules on a few rows made by hand."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from costurero.plans import cut_by_client as CC
from costurero.plans import cut_progress as CP
from costurero.plans import fabric_quality as FQ
from costurero.plans import order_progress as OP
from costurero.plans import packages as PK
from costurero.plans import schedule as SC
from tests.helpers import tables_of_rows

DAY = datetime(2024, 5, 10)


def sale(i, **kw):
    return dict(
        IdDocumento_OrdenVenta=i, CoddocOrdenVenta=f"P{i}", IdtdDocumentoForm=10, IdtdTipoVenta=4, bAnulado=0,
        IdmaeAnexo_Cliente=1, dtFechaEmision=datetime(2024, 5, 1), dtFechaEntrega=DAY, dtFechaPlanea=DAY,
        nvDocumentoReferencia=f"po-{i}", dCantidad=D(100),
    ) | kw


def fabric(order, asked, programmed, required, closed=1, approved=1, dyed=1, void=0):
    """A fabric order for ``order`` with one item and one dyeing step."""
    f, op = 1000 + order, 2000 + order
    return {
        "docOrdenVentaItem": [dict(IdDocumento_OrdenVenta=f, IdDocumento_Referencia=order, IdmaeItem=1, dCantidad=asked)],
        "docOrdenProduccion": [dict(IdDocumento_OrdenProduccion=op, IdDocumento_Referencia=f, IdtdDocumentoForm=126,
                                    bCerrado=closed, bCierreAprobado=approved, bAnulado=void)],
        "docOrdenProduccionItem": [dict(IdDocumento_OrdenProduccion=op, IdmaeItem=1, dCantidadProgramado=programmed,
                                        dCantidadRequerido=required)],
        "docOrdenProduccionRuta": [dict(IddocOrdenProduccionRuta=op, IdDocumento_OrdenProduccion=op,
                                        IdmaeCentroCosto=12, IdmaeReceta=3, bCerrado=dyed)],
    }


def garment(order, programmed, cut=None, closed=0):
    """A garment production order for ``order``, its cutting step and, perhaps, a cutting note."""
    op = 3000 + order
    rows = {
        "docOrdenProduccion": [dict(IdDocumento_OrdenProduccion=op, CoddocOrdenProduccion=f"OP{order}",
                                    IdDocumento_Referencia=order, IdtdDocumentoForm=127, bCerrado=closed,
                                    bCierreAprobado=0, bAnulado=0, IdmaeAnexo_Cliente=1)],
        "docOrdenProduccionItem": [dict(IdDocumento_OrdenProduccion=op, IdmaeItem=7, dCantidadProgramado=programmed,
                                        dCantidadRequerido=programmed)],
        "docOrdenProduccionRuta": [dict(IddocOrdenProduccionRuta=op, IdDocumento_OrdenProduccion=op,
                                        IdmaeCentroCosto=29, IdmaeReceta=0, bCerrado=0)],
    }
    if cut is not None:
        rows["docNotaInventario"] = [
            dict(IdDocumento_NotaInventario=op, IdDocumento_OrdenProduccion=op, IddocOrdenProduccionRuta=op,
                 IdmaeCentroCosto=29, IdtdDocumentoForm=131, bDevolucion=0, bDesactivado=0, bAnulado=0,
                 dtFechaRegistro=datetime(2024, 5, 3, 9))
        ]
        rows["docNotaInventarioItem"] = [
            dict(IdDocumento_NotaInventario=op, IdmaeItem_Inventario=7, dCantidadIng=cut)
        ]
    return rows


BASE = {
    "maeAnexoCliente": [dict(IdmaeAnexo_Cliente=1, NommaeAnexoCliente="CLIENTE DE NOMBRE LARGO")],
    "maeCentroCosto": [
        dict(IdmaeCentroCosto=29, NommaeCentroCosto="CORTE", bConOrdenProduccion=1),
        dict(IdmaeCentroCosto=47, NommaeCentroCosto="COSTURA", bConOrdenProduccion=1),
    ],
    "maeItemInventario": [dict(IdmaeItem_Inventario=7, IdtdItemForm=10, IdmaeEstilo=1, CodmaeItemInventario="IT7",
                               NommaeItemInventario="tela")],
}


def merge(*parts):
    out: dict[str, list[dict]] = {}
    for part in parts:
        for name, rows in part.items():
            out.setdefault(name, []).extend(rows)
    return out


def orders(spark, *parts, **kw):
    tables = tables_of_rows(spark, merge(BASE, *parts))
    rows = OP.order_progress(tables, "2024-05-01", "2024-05-31", **kw).collect()
    return {r.PEDIDO: r for r in rows}


def test_stages_of_one_order(spark):
    got = orders(
        spark, {"docOrdenVenta": [sale(1)]}, fabric(1, D(100), D("104.9"), D(90)), garment(1, D(50), D(20))
    )["P1"]
    assert (got.KG_REQ, got.KG_ARM, got.KG_X_ARM, got["KG_TEÑIDOS"], got["KG_ARM_X_TEÑIR"]) == (100, 104, 2, 104, 0)
    assert (got.KG_DESPACH, got.KG_APROB_D, got.KG_X_DESPACH, got.R, got.R1) == (90, 94, 10, 90.0, "105%")
    assert (got.UNID, got.PROG, got.CORTADO, got.COSIDO, got.DIAS, got.CLIENTE) == (100, 50, 20, 0, 9, "CLIENTE DE NOMB")


def test_an_order_without_partners_keeps_its_nulls_and_zeros(spark):
    got = orders(spark, {"docOrdenVenta": [sale(1)]}, variant="status")["P1"]
    assert (got.KG_REQ, got.KG_ARM, got.KG_X_ARM, got.R, got.KG_ARMP) == (0, None, None, None, None)
    assert (got.PROG, got.CORTADO, got.PROGP, got.con_tela, got.puede_cortar) == (0, 0, "0%", None, None)
    zero = orders(spark, {"docOrdenVenta": [sale(1)]}, fabric(1, D(0), D(5), D(5)), variant="status")["P1"]
    assert (zero.KG_REQ, zero.KG_ARM, zero.R, zero.disp_tela, zero.con_tela) == (0, 5, None, None, None)


@pytest.mark.parametrize(("approved", "expected"), [(D(120), 30), (D(10), 0), (None, None)])
def test_units_that_can_still_be_cut(spark, approved, expected):
    kilos = fabric(1, D(100), (approved or D(1)) / D("0.9"), D(1), approved=1 if approved else None)
    got = orders(
        spark, {"docOrdenVenta": [sale(1)]}, kilos, garment(1, D(50), D(20)), variant="status"
    )["P1"]
    assert got.con_tela == expected


def test_variants_differ_in_dates_and_flags(spark):
    parts = (
        {"docOrdenVenta": [sale(1), sale(2, dtFechaPlanea=None), sale(3, dtFechaEntrega=None),
                           sale(4, nvDocumentoReferencia=None), sale(5, IdtdTipoVenta=3), sale(6, bAnulado=1)]},
        fabric(1, D(10), D(10), D(10), void=1), garment(1, D(50), closed=1),
    )
    planned, delivery, status = (orders(spark, *parts, variant=v) for v in ("planned", "delivery", "status"))
    assert sorted(planned) == ["P1", "P3"]
    assert sorted(delivery) == ["P1", "P2"]
    assert sorted(status) == ["P1"]
    assert (planned["P1"].KG_ARM, delivery["P1"].KG_ARM, status["P1"].KG_ARM) == (None, 10, None)
    assert (planned["P1"].PROG, delivery["P1"].PROG, status["P1"].PROG) == (0, 0, 50)


def test_searches(spark):
    data = {"docOrdenVenta": [sale(1), sale(2), sale(12)]}
    assert sorted(orders(spark, data, pedido="p1")) == ["P1", "P12"]
    assert sorted(orders(spark, data, pedidos=" P2,, P12")) == ["P12", "P2"]
    assert sorted(orders(spark, data, po="PO-2")) == ["P2"]
    assert sorted(orders(spark, data, cliente="nombre")) == ["P1", "P12", "P2"]
    assert orders(spark, data, cliente="otro") == {}


def test_repeated_codes_routes_and_items_multiply(spark):
    twice = merge(fabric(1, D(10), D(8), D(8)), garment(1, D(50), D(20)))
    twice["docOrdenVentaItem"] *= 2
    twice["docOrdenProduccionRuta"] *= 2
    twice["docOrdenProduccionItem"] *= 2
    tables = tables_of_rows(spark, merge(BASE, {"docOrdenVenta": [sale(1), sale(2, CoddocOrdenVenta="P1")]}, twice))
    rows = OP.order_progress(tables, "2024-05-01", "2024-05-31").orderBy("PO", "PROG").collect()
    # two orders share a code: each shows the units of both; kilos stay with their own order
    assert [(r.PO, r.KG_REQ, r.KG_ARM, r.PROG, r.CORTADO) for r in rows] == [
        ("po-1", 20, 64, 0, 0), ("po-1", 20, 64, 200, 80), ("po-2", 0, None, 0, 0), ("po-2", 0, None, 200, 80)
    ]


def test_sub_lists_counts_and_totals(spark):
    df = spark.createDataFrame(
        [("A", 5, 1, 99.0), ("B", 0, 0, 97.0), ("C", -1, None, None), ("D", None, 2, 97.5)],
        "PEDIDO string, KG_X_ARM int, `KG_ARM_X_TEÑIR` int, R double",
    )
    names = {n: [r.PEDIDO for r in df.where(OP.sub_list_condition(n)).collect()] for n in ("to_assemble", "to_dye", "to_dispatch")}
    assert names == {"to_assemble": ["A", "D"], "to_dye": ["A", "D"], "to_dispatch": ["B", "C"]}
    assert tuple(OP.order_counts(df).first()) == (4, 2, 2, 2)


def cut(spark, *parts):
    return CC.cut_orders(tables_of_rows(spark, merge(BASE, *parts)), "2024-05-01", "2024-05-31")


def test_clients_equal_in_fifteen_characters_are_one_column(spark):
    clients = {"maeAnexoCliente": [dict(IdmaeAnexo_Cliente=2, NommaeAnexoCliente="CLIENTE DE NOMBRE CORTO")]}
    other = garment(2, D(1), D("7.9"))
    other["docOrdenProduccion"][0]["IdmaeAnexo_Cliente"] = 2
    got = CC.cut_by_client(CC.op_lists(cut(spark, clients, garment(1, D(1), D(20)), other)))
    assert got.columns == ["FECHA", "CLIENTE DE NOMB", "TOTAL", "CLIENTE DE NOMB_OP"]
    assert [tuple(r) for r in got.collect()] == [("03-05-2024", 27, 27, "OP1, OP2")]


def test_no_cuts_give_an_empty_table(spark):
    orders = cut(spark)
    got = CC.cut_by_client(CC.op_lists(orders))
    assert (got.columns, got.count()) == (["FECHA", "TOTAL"], 0)
    assert tuple(CC.cut_by_client_kpis(orders).first()) == (0, 0, 0.0)


def test_days_are_in_calendar_order_and_absent_cells_empty(spark):
    cells = spark.createDataFrame(
        [("2024-02-01", "A", 1, "x"), ("2024-01-02", "B", 2, "y")], "DIA string, CLIENTE string, UNID bigint, OPS string"
    ).withColumn("DIA", F.to_date("DIA"))
    got = CC.cut_by_client(cells)
    assert [tuple(r) for r in got.collect()] == [
        ("02-01-2024", 0, 2, 2, "", "y"), ("01-02-2024", 1, 0, 1, "x", "")
    ]


def test_cuts_without_a_client_name_are_in_no_column(spark):
    orders = spark.createDataFrame(
        [("2024-01-02", "C. `X`", "op1", 5), ("2024-01-02", None, "op2", 7), ("2024-01-03", None, "op3", 1)],
        "DIA string, CLIENTE string, OP string, UNID bigint",
    ).withColumn("DIA", F.to_date("DIA"))
    got = CC.cut_by_client(CC.op_lists(orders))
    assert got.columns == ["FECHA", "C. `X`", "TOTAL", "C. `X`_OP"]
    assert [tuple(r) for r in got.collect()] == [("02-01-2024", 5, 5, "op1"), ("03-01-2024", 0, 0, "")]
    assert tuple(CC.cut_by_client_kpis(orders).first()) == (2, 5, 2.5)


def test_cut_progress_filters(spark):
    rows = merge(BASE, {"docOrdenVenta": [sale(1), sale(2, dtFechaPlanea=datetime(2024, 5, 31, 1))]},
                 garment(1, D(5)), garment(2, D(5)), {
        "maeCombo": [dict(IdmaeCombo=1, NommaeCombo="ROJO")], "maeEstilo": [dict(IdmaeEstilo=1, nvModelo="MODELO")],
        "avanceCombo": [dict(IdDocumento_OrdenProduccion=3000 + i, IdmaeCentroCosto=29, IdmaeCombo=1,
                             IddocOrdenProduccionRuta=3000 + i, dCantidadRequerido=D(8), dCantidadProgramado=D(5),
                             dCantidadProducido=D(2)) for i in (1, 2)]})
    for op in rows["docOrdenProduccion"]:
        op["IdmaeEstilo"] = 1
        op["dtFechaEntrega"] = DAY
    tables = tables_of_rows(spark, rows)
    got = CP.cut_progress(tables, "2024-05-01", "2024-05-31").collect()
    assert [(r.OP, r.F_PLAN, r.PENDIENTE, r.PORCENT) for r in got] == [("OP1", "10-May", D(3), "25 %")]
    assert CP.cut_progress(tables, "2024-05-01", "2024-06-01", pedidos=["P2"]).first().OP == "OP2"
    assert CP.cut_progress(tables, "2024-05-01", "2024-06-01", cliente="  otro ").count() == 0
    assert CP.cut_progress(tables, "2024-05-01", "2024-06-01", cliente=" ").count() == 2


def service_orders():
    return merge(BASE, {"docOrdenVenta": [sale(1)]}, garment(1, D(5)), {
        "maeCombo": [dict(IdmaeCombo=1, NommaeCombo="ROJO"), dict(IdmaeCombo=2, NommaeCombo="AZUL")],
        "maeEstilo": [dict(IdmaeEstilo=1, NommaeEstilo="POLO")],
        "maeTalla": [dict(IdmaeTalla=1, NommaeTalla="M ", iSecuencia=2), dict(IdmaeTalla=2, NommaeTalla="S ", iSecuencia=1)],
        "docOrdenTrabajo": [
            dict(IdDocumento_OrdenTrabajo=1, CoddocOrdenTrabajo="OS1", IdDocumento_Referencia=3001, IdmaeCentroCosto=29,
                 ntObservacion="obs"),
            dict(IdDocumento_OrdenTrabajo=2, CoddocOrdenTrabajo="OS2", IdDocumento_Referencia=3001, IdmaeCentroCosto=47),
        ],
        "docOrdenTrabajoProduccion": [
            dict(IdDocumento_OrdenTrabajo=1, IdmaeItem=7, idmaecombo=1, IdmaeTalla=1, dCantidad=D(50)),
            dict(IdDocumento_OrdenTrabajo=1, IdmaeItem=7, idmaecombo=2, IdmaeTalla=1, dCantidad=D("50.9")),
            dict(IdDocumento_OrdenTrabajo=1, IdmaeItem=7, idmaecombo=1, IdmaeTalla=2, dCantidad=D(0)),
            dict(IdDocumento_OrdenTrabajo=2, IdmaeItem=7, idmaecombo=1, IdmaeTalla=1, dCantidad=D(9)),
        ],
        "docOrdentrabajoItem": [dict(IdDocumento_OrdenTrabajo=1, ntDescripcion="X" * 10 + "Y" * 35)],
        "docOrdenCompra": [dict(IdDocumento_OrdenCompra=1, CoddocOrdenCompra="OC1", IdDocumento_Referencia=3001,
                                IdmaeCentroCosto=29)],
        "docOrdenCompraProduccion": [dict(IdDocumento_OrdenCompra=1, IdmaeItem=7, idmaecombo=1, IdmaeTalla=2, dCantidad=D(12))],
        "docOrdenCompraItem": [dict(IdDocumento_OrdenCompra=1, ntDescripcion="hilo")] * 2,
    })


def test_packages_of_work_and_purchase_orders(spark):
    tables = tables_of_rows(spark, service_orders())
    got = PK.packages(tables, 40).orderBy("OS", "#").collect()
    assert [tuple(r) for r in got] == [
        ("OC1", 1, "S", 12, 1, 12), ("OC1", 2, "S", 12, 1, 12),
        ("OS1", 1, "M", 40, 1, 40), ("OS1", 2, "M", 10, 41, 50), ("OS1", 3, "M", 40, 1, 40), ("OS1", 4, "M", 10, 41, 50),
    ]
    assert PK.packages(tables, 40, "OC1").count() == 2
    assert {tuple(r) for r in PK.packages_by_size(tables).collect()} == {("OC1", "S", 24), ("OS1", "M", 100)}
    header = {r.OS: r for r in PK.packages_header(tables).collect()}
    assert (header["OS1"].COMBO, header["OS1"].MP, header["OS1"].OBS, header["OS1"].ESTILO) == ("AZUL", "Y" * 35, "obs", "POLO")
    assert PK.package_source(tables).count() == 5
    assert PK.packages(tables, 40, "NADA").count() == 0


def test_quality_searches_drop_nulls(spark):
    rows = merge(BASE, fabric(1, D(1), D(1), D(1)), {
        "maecolor": [dict(idmaecolor=1, nommaecolor="Azul")],
        "docOrdenProduccionCalidad": [
            dict(IdDocumento_OrdenProduccion=2001, idmaeitem=7, ntDescripcionAcabado=a, dAnchoAcabado=1.0,
                 dtFechaReporte=datetime(2024, 5, 31, 23)) for a in ("Liso", None)
        ]})
    rows["docOrdenProduccion"][0] |= {"IdmaeColor": 1, "IdmaeAnexo_Cliente": 1, "CoddocOrdenProduccion": "PA1"}
    tables = tables_of_rows(spark, rows)
    got = FQ.fabric_quality(tables, "2024-05-01", "2024-05-31")
    assert got.count() == 1
    assert FQ.fabric_quality(tables, "2024-05-01", "2024-05-31", color="AZ", acabado="li", partida="pa", tela="TEL").count() == 1
    assert FQ.fabric_quality(tables, "2024-05-01", "2024-05-31", codigo="zz").count() == 0
    assert {r.METRIC for r in FQ.quality_histogram(got).collect()} == {"ANCHO_ACABADO"}


def test_schedule_rules(spark):
    today = datetime(2024, 5, 20, 12)
    steps = [
        dict(Id_Proceso=1, Tiempo=20, Fecha_Inicial_Programada=DAY, Porcentaje_Avance=30, Fecha_Inicial_Real=DAY),
        dict(Id_Proceso=2, Tiempo=20, Fecha_Inicial_Programada=datetime(2024, 6, 1), Porcentaje_Avance=0),
        dict(Id_Proceso=3, Tiempo=0, Fecha_Inicial_Programada=DAY, Porcentaje_Avance=10),
        dict(Id_Proceso=4, Tiempo=5, Porcentaje_Avance=10),
        dict(Id_Proceso=5, Tiempo=4, Fecha_Inicial_Programada=DAY, Porcentaje_Avance=100, Fecha_Final_Real=DAY),
    ]
    tables = tables_of_rows(spark, {
        "Pedido": [dict(Id_Pedido=1, Nompedido="uno", Fecha_Emision=DAY, Fecha_Entrega=DAY)],
        "Proceso": [s | {"Id_Pedido": 1} for s in steps],
    })
    got = {r.Id_Proceso: r for r in SC.schedule(tables, today).collect()}
    assert [(got[i].PCT_ESPERADO, got[i].PCT_MOSTRADO) for i in range(1, 6)] == [
        (50.0, 0.3), (0.0, 0.0), (None, None), (None, None), (100.0, 1.0)
    ]
    assert got[1].FIN == datetime(2024, 5, 30)
    assert (got[1].ETIQUETA_REAL, got[1].ETIQUETA_ESPERADO, got[1].MARCA_INICIO, got[1].MARCA_FIN) == ("30%", "50%", DAY, None)
    assert (got[2].INICIADO, got[5].MARCA_FIN) == (0, DAY)
    assert SC.schedule(tables, today, 2).count() == 0
