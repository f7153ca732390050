"""Column contract of every input table: name and type, nothing else is read.

Document keys are ``long`` so that they hold at any size; quantities are exact
``decimal(18,4)``; flags are integer 0/1, because a flag is used both as a
predicate and as a multiplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "flag": T.IntegerType(),
    "qty": T.DecimalType(18, 4),
    "ratio": T.DoubleType(),
    "text": T.StringType(),
    "time": T.TimestampNTZType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


_PROGRESS = {
    "dCantidadRequerido": "qty",
    "dCantidadProgramado": "qty",
    "dCantidadProducido": "qty",
}

TABLES: dict[str, T.StructType] = {
    # masters
    "maeAnexoCliente": _table(IdmaeAnexo_Cliente="long", NommaeAnexoCliente="text"),
    "maeCentroCosto": _table(IdmaeCentroCosto="int", NommaeCentroCosto="text", bConOrdenProduccion="flag"),
    "maeCombo": _table(IdmaeCombo="int", NommaeCombo="text"),
    "maecolor": _table(idmaecolor="int", nommaecolor="text"),
    "maeTalla": _table(IdmaeTalla="int", NommaeTalla="text", iSecuencia="int"),
    "maeEstilo": _table(IdmaeEstilo="int", nvModelo="text", NommaeEstilo="text"),
    "maeItemInventario": _table(
        IdmaeItem_Inventario="long", CodmaeItemInventario="text", NommaeItemInventario="text",
        IdtdItemForm="int", IdmaeEstilo="int",
    ),
    # sales
    "docOrdenVenta": _table(
        IdDocumento_OrdenVenta="long", CoddocOrdenVenta="text", IdtdDocumentoForm="int", IdtdTipoVenta="int",
        bAnulado="flag", IdmaeAnexo_Cliente="long", dtFechaEmision="time", dtFechaEntrega="time",
        dtFechaPlanea="time", nvDocumentoReferencia="text", dCantidad="qty",
    ),
    "docOrdenVentaItem": _table(
        IdDocumento_OrdenVenta="long", IdDocumento_Referencia="long", IdmaeItem="long", dCantidad="qty",
    ),
    # production
    "docOrdenProduccion": _table(
        IdDocumento_OrdenProduccion="long", CoddocOrdenProduccion="text", IdDocumento_Referencia="long",
        IdtdDocumentoForm="int", bCerrado="flag", bCierreAprobado="flag", bAnulado="flag",
        IdmaeAnexo_Cliente="long", IdmaeEstilo="int", IdmaeColor="int", dtFechaEntrega="time",
        nvDocumentoReferencia="text",
    ),
    "docOrdenProduccionItem": _table(
        IdDocumento_OrdenProduccion="long", IdmaeItem="long", dCantidadProgramado="qty", dCantidadRequerido="qty",
    ),
    "docOrdenProduccionRuta": _table(
        IddocOrdenProduccionRuta="long", IdDocumento_OrdenProduccion="long", IdmaeCentroCosto="int",
        IdmaeReceta="int", bCerrado="flag",
    ),
    "avanceComboTalla": _table(
        IdDocumento_OrdenProduccion="long", IdmaeCentroCosto="int", IdmaeCombo="int", IdmaeTalla="int",
        IddocOrdenProduccionRuta="long", **_PROGRESS,
    ),
    "avanceCombo": _table(
        IdDocumento_OrdenProduccion="long", IdmaeCentroCosto="int", IdmaeCombo="int",
        IddocOrdenProduccionRuta="long", **_PROGRESS,
    ),
    # stock
    "docNotaInventario": _table(
        IdDocumento_NotaInventario="long", IdDocumento_OrdenProduccion="long", IddocOrdenProduccionRuta="long",
        IdmaeCentroCosto="int", IdtdDocumentoForm="int", bDevolucion="flag", bDesactivado="flag",
        bAnulado="flag", dtFechaRegistro="time",
    ),
    "docNotaInventarioItem": _table(
        IdDocumento_NotaInventario="long", IdmaeItem_Inventario="long", dCantidadIng="qty",
    ),
    # service orders
    "docOrdenTrabajo": _table(
        IdDocumento_OrdenTrabajo="long", CoddocOrdenTrabajo="text", IdDocumento_Referencia="long",
        IdmaeCentroCosto="int", ntObservacion="text",
    ),
    "docOrdenTrabajoProduccion": _table(
        IdDocumento_OrdenTrabajo="long", IdmaeItem="long", idmaecombo="int", IdmaeTalla="int", dCantidad="qty",
    ),
    "docOrdentrabajoItem": _table(IdDocumento_OrdenTrabajo="long", ntDescripcion="text"),
    "docOrdenCompra": _table(
        IdDocumento_OrdenCompra="long", CoddocOrdenCompra="text", IdDocumento_Referencia="long",
        IdmaeCentroCosto="int", ntObservacion="text",
    ),
    "docOrdenCompraProduccion": _table(
        IdDocumento_OrdenCompra="long", IdmaeItem="long", idmaecombo="int", IdmaeTalla="int", dCantidad="qty",
    ),
    "docOrdenCompraItem": _table(IdDocumento_OrdenCompra="long", ntDescripcion="text"),
    # fabric quality
    "docOrdenProduccionCalidad": _table(
        IdDocumento_OrdenProduccion="long", idmaeitem="long", CoddocOrdenProduccionCalidad="text",
        ntDescripcionAcabado="text", dAnchoAcabado="ratio", AATCC135_EncogLargo="ratio",
        AATCC135_EncogAncho="ratio", AATCC179_ReviradoLavado="ratio", AATCC179_DensidadAcabada="ratio",
        nvTituloObservacion="text", ntObservacion="text", dtFechaReporte="time",
    ),
    # schedule
    "Pedido": _table(Id_Pedido="long", Fecha_Emision="time", Fecha_Entrega="time", Nompedido="text"),
    "Proceso": _table(
        Id_Pedido="long", Id_Proceso="long", Tiempo="int", Fecha_Inicial_Programada="time",
        Fecha_Inicial_Real="time", Fecha_Final_Real="time", Porcentaje_Avance="int",
    ),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Keep the contract columns only, in the contract types.

    A cast to the type a column already has disappears in the optimizer, so
    filters still reach the scan.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
