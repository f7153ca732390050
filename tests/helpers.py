"""Garment tables made by hand or at random."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

from costurero.schemas import TABLES
from costurero.sources.registry import Tables


def frames_of(spark, rows: dict[str, list[dict]]):
    """A DataFrame per table; columns not given are null, tables not given are empty."""
    frames = {}
    for name, schema in TABLES.items():
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows.get(name, [])]
        frames[name] = spark.createDataFrame(data, schema)
    return frames


def tables_of_rows(spark, rows: dict[str, list[dict]], **kw) -> Tables:
    frames = frames_of(spark, rows)
    return Tables.from_conf(spark, {n: {"frame": f} for n, f in frames.items()}, **kw)


def random_rows(seed: int = 7, size: int = 600) -> dict[str, list[dict]]:
    """Every table filled at random: duplicates, nulls, missing partners, and one hot key that
    holds a third of the rows of each document table."""
    rnd = random.Random(seed)
    day0 = datetime(1996, 1, 1)

    def hot(n: int, first: int = 1) -> int:
        return first if rnd.random() < 1 / 3 else first + rnd.randrange(n)

    def qty(top: int = 60) -> Decimal:
        return Decimal(rnd.randrange(0, top * 4)) / 4

    def flag(p: float = 0.5) -> int:
        return int(rnd.random() < p)

    def moment(days: int = 900) -> datetime:
        return day0 + timedelta(days=rnd.randrange(days), hours=rnd.choice([0, 0, 5, 13, 23]))

    def maybe(value, p: float = 0.1):
        return None if rnd.random() < p else value

    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows: dict[str, list[dict]] = {n: [] for n in TABLES}
    for i in range(1, 21):
        rows["maeAnexoCliente"].append(
            dict(IdmaeAnexo_Cliente=i, NommaeAnexoCliente=f"{segments[i % 5]} Customer#{i}")
        )
    for i, (name, used) in {29: ("CORTE", 1), 47: ("COSTURA", 1), 12: ("TINTORERIA", 0)}.items():
        rows["maeCentroCosto"].append(dict(IdmaeCentroCosto=i, NommaeCentroCosto=name, bConOrdenProduccion=used))
    for i in range(1, 6):
        rows["maeCombo"].append(dict(IdmaeCombo=i, NommaeCombo=f"COMBO {i}"))
        rows["maecolor"].append(dict(idmaecolor=i, nommaecolor=f"COLOR {i}"))
        rows["maeEstilo"].append(dict(IdmaeEstilo=i, nvModelo=f"MODELO LARGO {i}", NommaeEstilo=f"ESTILO {i}"))
    for i in range(1, 8):
        rows["maeTalla"].append(dict(IdmaeTalla=i, NommaeTalla=f"T{i} ", iSecuencia=(i + 1) // 2))
    for i in range(1, 41):
        rows["maeItemInventario"].append(
            dict(IdmaeItem_Inventario=i, CodmaeItemInventario=f"IT{i}", NommaeItemInventario=f"tela widget {i}",
                 IdtdItemForm=10 if i % 5 else 11, IdmaeEstilo=i % 6 + 1)
        )

    orders = size // 2
    for i in range(1, orders + 1):
        issued = moment()
        rows["docOrdenVenta"].append(
            dict(IdDocumento_OrdenVenta=i, CoddocOrdenVenta=f"P{i - i % 7 if i % 7 == 1 else i}",
                 IdtdDocumentoForm=10 if flag(0.9) else 20, IdtdTipoVenta=4 if flag(0.9) else 3,
                 bAnulado=flag(0.05), IdmaeAnexo_Cliente=hot(22), dtFechaEmision=issued,
                 dtFechaEntrega=maybe(issued + timedelta(days=rnd.randrange(60), hours=rnd.randrange(24))),
                 dtFechaPlanea=maybe(issued + timedelta(days=rnd.randrange(60), hours=rnd.choice([0, 11, 12]))),
                 nvDocumentoReferencia=maybe(f"PO-{i % 9}"), dCantidad=qty(500))
        )
    for _ in range(size * 3):
        rows["docOrdenVentaItem"].append(
            dict(IdDocumento_OrdenVenta=hot(orders), IdDocumento_Referencia=hot(orders, 0),
                 IdmaeItem=hot(12), dCantidad=qty())
        )
    for i in range(1, size + 1):
        rows["docOrdenProduccion"].append(
            dict(IdDocumento_OrdenProduccion=i, CoddocOrdenProduccion=f"OP{i - i % 11 if i % 11 == 1 else i}",
                 IdDocumento_Referencia=hot(orders), IdtdDocumentoForm=127 if flag(0.6) else 126,
                 bCerrado=maybe(flag(0.4)), bCierreAprobado=maybe(flag()), bAnulado=flag(0.1),
                 IdmaeAnexo_Cliente=hot(22), IdmaeEstilo=maybe(hot(6)), IdmaeColor=maybe(hot(6)),
                 dtFechaEntrega=datetime(2000, 6, 1) + timedelta(days=rnd.randrange(-400, 400)),
                 nvDocumentoReferencia=maybe(f"P{i}"))
        )
    for i, op in enumerate(rows["docOrdenProduccion"][:40]):  # open garment orders of every client
        op.update(IdtdDocumentoForm=127, bCerrado=0, bAnulado=0, IdmaeAnexo_Cliente=i % 20 + 1)
    routes = size * 2
    for i in range(1, routes + 1):
        rows["docOrdenProduccionRuta"].append(
            dict(IddocOrdenProduccionRuta=i - i % 13 if i % 13 == 1 else i, IdDocumento_OrdenProduccion=hot(size),
                 IdmaeCentroCosto=rnd.choice([29, 29, 47, 12]), IdmaeReceta=rnd.randrange(3), bCerrado=flag())
        )
    for _ in range(size * 3):
        rows["docOrdenProduccionItem"].append(
            dict(IdDocumento_OrdenProduccion=hot(size), IdmaeItem=hot(12),
                 dCantidadProgramado=qty(), dCantidadRequerido=qty())
        )
        rows["avanceComboTalla"].append(
            dict(IdDocumento_OrdenProduccion=hot(size), IdmaeCentroCosto=rnd.choice([29, 47]), IdmaeCombo=hot(6),
                 IdmaeTalla=hot(8), IddocOrdenProduccionRuta=hot(routes), dCantidadRequerido=qty(3),
                 dCantidadProgramado=qty(3), dCantidadProducido=qty(3))
        )
        rows["avanceCombo"].append(
            dict(IdDocumento_OrdenProduccion=hot(size), IdmaeCentroCosto=rnd.choice([29, 47]), IdmaeCombo=hot(6),
                 IddocOrdenProduccionRuta=hot(routes), dCantidadRequerido=qty(3),
                 dCantidadProgramado=qty(3), dCantidadProducido=qty(3))
        )
    for i in range(1, size * 3 + 1):
        rows["docNotaInventario"].append(
            dict(IdDocumento_NotaInventario=i, IdDocumento_OrdenProduccion=hot(size),
                 IddocOrdenProduccionRuta=hot(routes), IdmaeCentroCosto=rnd.choice([29, 47, 12]),
                 IdtdDocumentoForm=131 if flag(0.9) else 130, bDevolucion=flag(0.1), bDesactivado=flag(0.05),
                 bAnulado=flag(0.05), dtFechaRegistro=moment())
        )
    for _ in range(size * 4):
        rows["docNotaInventarioItem"].append(
            dict(IdDocumento_NotaInventario=hot(size * 3), IdmaeItem_Inventario=hot(12), dCantidadIng=qty(20))
        )
    for kind in ("Trabajo", "Compra"):
        key = f"IdDocumento_Orden{kind}"
        for i in range(1, size // 4 + 1):
            rows[f"docOrden{kind}"].append(
                {key: i, f"CoddocOrden{kind}": f"OS{i if kind == 'Trabajo' else i + 20}",
                 "IdDocumento_Referencia": hot(size), "IdmaeCentroCosto": 29 if flag(0.8) else 47,
                 "ntObservacion": maybe(f"obs {i}")}
            )
        for _ in range(size * 2):
            rows[f"docOrden{kind}Produccion"].append(
                {key: hot(size // 4), "IdmaeItem": hot(45), "idmaecombo": hot(6), "IdmaeTalla": hot(8),
                 "dCantidad": qty(150)}
            )
        material = "docOrdentrabajoItem" if kind == "Trabajo" else "docOrdenCompraItem"
        for _ in range(size // 3):
            rows[material].append({key: hot(size // 4), "ntDescripcion": f"HILO {rnd.randrange(4)}"})
    for i in range(size * 2):
        rows["docOrdenProduccionCalidad"].append(
            dict(IdDocumento_OrdenProduccion=hot(size), idmaeitem=hot(45), CoddocOrdenProduccionCalidad=f"QC{i}",
                 ntDescripcionAcabado=maybe(f"AC{i % 3}"), dAnchoAcabado=maybe(rnd.randrange(100) / 7),
                 AATCC135_EncogLargo=maybe(rnd.gauss(0, 3)), AATCC135_EncogAncho=5.0,
                 AATCC179_ReviradoLavado=None, AATCC179_DensidadAcabada=rnd.randrange(31) * 1.0,
                 nvTituloObservacion=maybe("t, \"con\" comas"), ntObservacion=maybe("o"), dtFechaReporte=moment())
        )
    for i in range(size // 4):
        issued = moment()
        rows["Pedido"].append(
            dict(Id_Pedido=i, Fecha_Emision=issued, Fecha_Entrega=issued + timedelta(days=rnd.randrange(0, 90)),
                 Nompedido=f"Pedido {i}")
        )
    for i in range(size):
        began = moment(1200)
        rows["Proceso"].append(
            dict(Id_Pedido=hot(size // 4, 0), Id_Proceso=i, Tiempo=rnd.randrange(0, 60),
                 Fecha_Inicial_Programada=maybe(began), Fecha_Inicial_Real=maybe(began), Fecha_Final_Real=maybe(began),
                 Porcentaje_Avance=maybe(rnd.choice([0, 30, 70, 100])))
        )
    return rows
