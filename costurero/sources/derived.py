"""Garment tables derived from a star schema of customers, orders, lines and parts.

Each text runs unchanged on Spark and on an ANSI database; ``{name}`` marks an
input. Only ``EACH_CENTRE``, one row per work centre, is spelled differently.
"""

from __future__ import annotations

from string import Formatter
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from costurero.schemas import TABLES, conform
from costurero.sources.registry import Tables
from costurero.sources.sinks import lay_out

STAR = ("customer", "orders", "lineitem", "part")

EACH_CENTRE = {"spark": "explode(array(29, 47))", "ansi": "unnest([29, 47])"}

TEXTS: dict[str, str] = {
    "maeAnexoCliente": """
        SELECT c_custkey AS IdmaeAnexo_Cliente, c_mktsegment || ' ' || c_name AS NommaeAnexoCliente
        FROM {customer}""",
    "maeCentroCosto": """
        SELECT * FROM (VALUES (29,'CORTE',1),(47,'COSTURA',1),(12,'TINTORERIA',0))
            AS t(IdmaeCentroCosto, NommaeCentroCosto, bConOrdenProduccion)""",
    "maeCombo": """
        SELECT * FROM (VALUES (1,'AZUL'),(2,'ROJO'),(3,'NEGRO'),(4,'BLANCO'),(5,'VERDE'))
            AS t(IdmaeCombo, NommaeCombo)""",
    "maecolor": """
        SELECT IdmaeCombo - 1 AS idmaecolor, NommaeCombo AS nommaecolor FROM {maeCombo}""",
    "maeTalla": """
        SELECT * FROM (VALUES (1,'XS ',1),(2,'S ',2),(3,'M ',3),(4,'L ',4),(5,'XL ',5),(6,'XXL ',6),(7,'3XL ',7))
            AS t(IdmaeTalla, NommaeTalla, iSecuencia)""",
    # 25 styles, each named after the parts that carry it
    "maeEstilo": """
        SELECT CAST(p_partkey % 25 + 1 AS INT) AS IdmaeEstilo,
               'MOD-' || MIN(p_brand) || '-' || MIN(p_type) AS nvModelo, MIN(p_name) AS NommaeEstilo
        FROM {part} GROUP BY CAST(p_partkey % 25 + 1 AS INT)""",
    "maeItemInventario": """
        SELECT p_partkey AS IdmaeItem_Inventario, 'IT' || lpad(CAST(p_partkey AS STRING), 6, '0') AS CodmaeItemInventario,
               p_name AS NommaeItemInventario, CASE WHEN p_size % 10 = 0 THEN 11 ELSE 10 END AS IdtdItemForm,
               CAST(p_partkey % 25 + 1 AS INT) AS IdmaeEstilo
        FROM {part}""",
    "docOrdenVenta": """
        SELECT o_orderkey + 1 AS IdDocumento_OrdenVenta,
               'PED' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0') AS CoddocOrdenVenta,
               10 AS IdtdDocumentoForm, CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE 4 END AS IdtdTipoVenta,
               CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS bAnulado, o_custkey AS IdmaeAnexo_Cliente,
               o_orderdate AS dtFechaEmision,
               o_orderdate + INTERVAL '1' DAY * CAST(30 + o_orderkey % 60 AS INT) AS dtFechaEntrega,
               CASE WHEN o_orderkey % 50 = 7 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' DAY * CAST(30 + o_orderkey % 60 + o_orderkey % 7 AS INT)
               END AS dtFechaPlanea,
               CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE 'po-' || CAST(o_custkey AS STRING) END AS nvDocumentoReferencia,
               CAST(o_totalprice AS DECIMAL(18,4)) AS dCantidad
        FROM {orders}
        UNION ALL
        SELECT o_orderkey + 1000000001, 'TEL' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0'), 20, 1, 0, o_custkey,
               o_orderdate, o_orderdate, o_orderdate, NULL, CAST(0 AS DECIMAL(18,4))
        FROM {orders}""",
    "docOrdenVentaItem": """
        SELECT l_orderkey + 1000000001 AS IdDocumento_OrdenVenta,
               CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_orderkey + 1 END AS IdDocumento_Referencia,
               l_partkey AS IdmaeItem, CAST(l_quantity AS DECIMAL(18,4)) AS dCantidad
        FROM {lineitem}""",
    "docOrdenProduccion": """
        SELECT o_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion,
               'OP' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0') AS CoddocOrdenProduccion,
               o_orderkey + 1 AS IdDocumento_Referencia, 127 AS IdtdDocumentoForm,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS bCerrado, 0 AS bCierreAprobado,
               CASE WHEN o_orderkey % 30 = 1 THEN 1 ELSE 0 END AS bAnulado, o_custkey AS IdmaeAnexo_Cliente,
               CAST(o_orderkey % 25 + 1 AS INT) AS IdmaeEstilo, CAST(NULL AS INT) AS IdmaeColor,
               o_orderdate + INTERVAL '1' DAY * CAST(30 + o_orderkey % 60 AS INT) AS dtFechaEntrega,
               CAST(NULL AS STRING) AS nvDocumentoReferencia
        FROM {orders}
        UNION ALL
        SELECT o_orderkey * 2 + 3, 'PA' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0'), o_orderkey + 1000000001, 126,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END,
               CASE WHEN o_orderkey % 45 = 2 THEN 1 ELSE 0 END, o_custkey, NULL, CAST(o_orderkey % 5 AS INT),
               o_orderdate, 'PED' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0')
        FROM {orders}""",
    "docOrdenProduccionItem": """
        SELECT l_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion, l_partkey AS IdmaeItem,
               CAST(l_quantity * 10 AS DECIMAL(18,4)) AS dCantidadProgramado,
               CAST(l_quantity * 10 AS DECIMAL(18,4)) AS dCantidadRequerido
        FROM {lineitem}
        UNION ALL
        SELECT l_orderkey * 2 + 3, l_partkey, CAST(CAST(l_quantity AS DECIMAL(9,2)) * 1.05 AS DECIMAL(18,4)),
               CAST(l_quantity AS DECIMAL(18,4))
        FROM {lineitem}""",
    "docOrdenProduccionRuta": """
        SELECT (o_orderkey * 2 + 2) * 4 AS IddocOrdenProduccionRuta, o_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion,
               29 AS IdmaeCentroCosto, 0 AS IdmaeReceta, 0 AS bCerrado
        FROM {orders}
        UNION ALL
        SELECT (o_orderkey * 2 + 2) * 4 + 1, o_orderkey * 2 + 2, 47, 0, 0 FROM {orders}
        UNION ALL
        SELECT (o_orderkey * 2 + 3) * 4 + 2, o_orderkey * 2 + 3, 12, CAST(1 + o_orderkey % 5 AS INT),
               CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END
        FROM {orders}""",
    # flags are single letters; the greatest letter is taken by its code, which aggregates by hash
    "notaBase": """
        SELECT l_orderkey, l_linenumber, MIN(l_shipdate) AS shipdate,
               MAX(ascii(l_returnflag)) AS rf, MAX(ascii(l_linestatus)) AS ls
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "docNotaInventario": """
        SELECT (l_orderkey * 8 + l_linenumber) * 2 AS IdDocumento_NotaInventario,
               l_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion, (l_orderkey * 2 + 2) * 4 AS IddocOrdenProduccionRuta,
               29 AS IdmaeCentroCosto, 131 AS IdtdDocumentoForm, CASE WHEN rf = ascii('R') THEN 1 ELSE 0 END AS bDevolucion,
               0 AS bDesactivado, CASE WHEN l_orderkey % 33 = 4 THEN 1 ELSE 0 END AS bAnulado,
               shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS dtFechaRegistro
        FROM {notaBase}
        UNION ALL
        SELECT (l_orderkey * 8 + l_linenumber) * 2 + 1, l_orderkey * 2 + 2, (l_orderkey * 2 + 2) * 4 + 1, 47, 131,
               CASE WHEN rf = ascii('R') THEN 1 ELSE 0 END, 0, 0, shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT)
        FROM {notaBase} WHERE ls = ascii('F')""",
    "docNotaInventarioItem": """
        SELECT (l_orderkey * 8 + l_linenumber) * 2 AS IdDocumento_NotaInventario, l_partkey AS IdmaeItem_Inventario,
               CAST(CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_quantity * 8 END AS DECIMAL(18,4)) AS dCantidadIng
        FROM {lineitem}
        UNION ALL
        SELECT (l_orderkey * 8 + l_linenumber) * 2 + 1, l_partkey, CAST(l_quantity * 6 AS DECIMAL(18,4))
        FROM {lineitem}""",
    "avanceComboTalla": """
        SELECT l_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion, centro AS IdmaeCentroCosto,
               CAST(l_partkey % 5 + 1 AS INT) AS IdmaeCombo, l_linenumber AS IdmaeTalla,
               (l_orderkey * 2 + 2) * 4 + CASE WHEN centro = 29 THEN 0 ELSE 1 END AS IddocOrdenProduccionRuta,
               CAST(l_quantity * 10 AS DECIMAL(18,4)) AS dCantidadRequerido,
               CAST(CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE l_quantity * 10 END AS DECIMAL(18,4)) AS dCantidadProgramado,
               CAST(CASE WHEN centro = 29 THEN l_quantity * 8 WHEN l_linestatus = 'F' THEN l_quantity * 6 ELSE 0 END
                    AS DECIMAL(18,4)) AS dCantidadProducido
        FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_linestatus, EACH_CENTRE AS centro
              FROM {lineitem}) AS lineas""",
    "avanceCombo": """
        SELECT IdDocumento_OrdenProduccion, IdmaeCentroCosto, IdmaeCombo, IddocOrdenProduccionRuta,
               SUM(dCantidadRequerido) AS dCantidadRequerido, SUM(dCantidadProgramado) AS dCantidadProgramado,
               SUM(dCantidadProducido) AS dCantidadProducido
        FROM {avanceComboTalla}
        GROUP BY IdDocumento_OrdenProduccion, IdmaeCentroCosto, IdmaeCombo, IddocOrdenProduccionRuta""",
    # every order is either a work order or, one in three, a purchase order
    "docOrdenTrabajo": """
        SELECT o_orderkey + 1 AS IdDocumento_OrdenTrabajo,
               'OS' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0') AS CoddocOrdenTrabajo,
               o_orderkey * 2 + 2 AS IdDocumento_Referencia,
               CASE WHEN o_orderkey % 4 = 3 THEN 47 ELSE 29 END AS IdmaeCentroCosto, o_orderpriority AS ntObservacion
        FROM {orders} WHERE o_orderkey % 3 <> 0""",
    "docOrdenTrabajoProduccion": """
        SELECT l_orderkey + 1 AS IdDocumento_OrdenTrabajo, l_partkey AS IdmaeItem,
               CAST(l_partkey % 5 + 1 AS INT) AS idmaecombo, l_linenumber AS IdmaeTalla,
               CAST(l_quantity * 3 AS DECIMAL(18,4)) AS dCantidad
        FROM {lineitem} WHERE l_orderkey % 3 <> 0""",
    "docOrdentrabajoItem": """
        SELECT o_orderkey + 1 AS IdDocumento_OrdenTrabajo,
               'MATERIA PRIMA PARA LA ORDEN DE TRABAJO ' || CAST(o_orderkey + 1 AS STRING) AS ntDescripcion
        FROM {orders} WHERE o_orderkey % 3 <> 0""",
    "docOrdenCompra": """
        SELECT o_orderkey + 1 AS IdDocumento_OrdenCompra,
               'OS' || lpad(CAST(o_orderkey + 1 AS STRING), 8, '0') AS CoddocOrdenCompra,
               o_orderkey * 2 + 2 AS IdDocumento_Referencia, 29 AS IdmaeCentroCosto, o_orderpriority AS ntObservacion
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "docOrdenCompraProduccion": """
        SELECT l_orderkey + 1 AS IdDocumento_OrdenCompra, l_partkey AS IdmaeItem,
               CAST(l_partkey % 5 + 1 AS INT) AS idmaecombo, l_linenumber AS IdmaeTalla,
               CAST(l_quantity * 3 AS DECIMAL(18,4)) AS dCantidad
        FROM {lineitem} WHERE l_orderkey % 3 = 0""",
    "docOrdenCompraItem": """
        SELECT o_orderkey + 1 AS IdDocumento_OrdenCompra,
               'MATERIA PRIMA PARA LA ORDEN DE COMPRA ' || CAST(o_orderkey + 1 AS STRING) AS ntDescripcion
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    # one report per line
    "docOrdenProduccionCalidad": """
        SELECT l_orderkey * 2 + 3 AS IdDocumento_OrdenProduccion, l_partkey AS idmaeitem,
               'QC' || CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) AS CoddocOrdenProduccionCalidad,
               l_returnflag || l_linestatus AS ntDescripcionAcabado, l_quantity * 4 AS dAnchoAcabado,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE -l_discount * 100 END AS AATCC135_EncogLargo,
               -l_tax * 100 AS AATCC135_EncogAncho, l_discount * 50 AS AATCC179_ReviradoLavado,
               l_extendedprice / 500 AS AATCC179_DensidadAcabada, CAST(NULL AS STRING) AS nvTituloObservacion,
               CAST(NULL AS STRING) AS ntObservacion,
               l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS dtFechaReporte
        FROM {lineitem}""",
    "Pedido": """
        SELECT o_orderkey AS Id_Pedido, o_orderdate AS Fecha_Emision,
               o_orderdate + INTERVAL '1' DAY * CAST(30 + o_orderkey % 60 AS INT) AS Fecha_Entrega,
               'Pedido ' || CAST(o_orderkey AS STRING) AS Nompedido
        FROM {orders}""",
    "Proceso": """
        SELECT l_orderkey AS Id_Pedido, l_linenumber AS Id_Proceso, CAST(MAX(l_quantity) AS INT) AS Tiempo,
               MIN(l_shipdate) AS Fecha_Inicial_Programada,
               CASE WHEN MAX(l_tax) > 0.03 THEN MIN(l_shipdate) + INTERVAL '2' DAY END AS Fecha_Inicial_Real,
               CASE WHEN MAX(ascii(l_linestatus)) = ascii('F') THEN MAX(l_shipdate) + INTERVAL '9' DAY END AS Fecha_Final_Real,
               CAST(CASE WHEN MAX(ascii(l_linestatus)) = ascii('F') THEN 100 ELSE MAX(l_discount) * 1000 END AS INT) AS Porcentaje_Avance
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
}

# The same rows where Spark reads them: what the texts above give in two parts comes from one pass over the lines, so that
# the lines are grouped, and what needs them is shuffled, once.
ONE_PASS: dict[str, str] = {
    "docOrdenProduccionItem": """
        SELECT l_orderkey * 2 + 2 + tela AS IdDocumento_OrdenProduccion, l_partkey AS IdmaeItem,
               CASE WHEN tela = 0 THEN CAST(l_quantity * 10 AS DECIMAL(18,4))
                    ELSE CAST(CAST(l_quantity AS DECIMAL(9,2)) * 1.05 AS DECIMAL(18,4)) END AS dCantidadProgramado,
               CASE WHEN tela = 0 THEN CAST(l_quantity * 10 AS DECIMAL(18,4))
                    ELSE CAST(l_quantity AS DECIMAL(18,4)) END AS dCantidadRequerido
        FROM (SELECT l_orderkey, l_partkey, l_quantity, explode(array(0, 1)) AS tela FROM {lineitem}) AS lineas""",
    "docNotaInventario": """
        SELECT (l_orderkey * 8 + l_linenumber) * 2 + cosido AS IdDocumento_NotaInventario,
               l_orderkey * 2 + 2 AS IdDocumento_OrdenProduccion, (l_orderkey * 2 + 2) * 4 + cosido AS IddocOrdenProduccionRuta,
               CASE WHEN cosido = 0 THEN 29 ELSE 47 END AS IdmaeCentroCosto, 131 AS IdtdDocumentoForm,
               CASE WHEN rf = ascii('R') THEN 1 ELSE 0 END AS bDevolucion, 0 AS bDesactivado,
               CASE WHEN cosido = 0 AND l_orderkey % 33 = 4 THEN 1 ELSE 0 END AS bAnulado,
               shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS dtFechaRegistro
        FROM (SELECT l_orderkey, l_linenumber, shipdate, rf,
                     explode(CASE WHEN ls = ascii('F') THEN array(0, 1) ELSE array(0) END) AS cosido
              FROM {notaBase}) AS notas""",
}


def inputs(text: str) -> list[str]:
    """The names a text reads from, in order of appearance."""
    return list(dict.fromkeys(field for _, field, _, _ in Formatter().parse(text) if field))


def star_tables(spark: SparkSession, folder: str) -> Tables:
    """The garment tables over the parquet star schema in ``folder``."""
    frames: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in frames:
            if name in STAR:
                frames[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            else:
                text = ONE_PASS.get(name, TEXTS[name]).replace("EACH_CENTRE", EACH_CENTRE["spark"])
                df = spark.sql(text, **{i: frame(i) for i in inputs(text)})
                frames[name] = conform(df, name) if name in TABLES else df
        return frames[name]

    return Tables(frame)


def catalog_tables(spark: SparkSession, folder: str) -> Tables:
    """The garment tables as views of a catalog over the folder's files, read by their three-part names.

    The files are registered where they lie, nothing is copied; a schema of its own per folder keeps them apart.
    """
    schema = f"spark_catalog.costurero_{crc32(folder.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    for name in STAR:
        path = f"{folder}/{name}.parquet".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} USING parquet LOCATION '{path}'")
    for name, text in TEXTS.items():
        body = text.replace("EACH_CENTRE", EACH_CENTRE["spark"])
        spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} AS {body.format(**{i: f'{schema}.{i}' for i in inputs(body)})}")
    return Tables.from_conf(spark, {name: {"table": f"{schema}.{name}"} for name in TABLES})


#: Stock notes and their lines, by the id they share.
_LAID_OUT = {"docNotaInventario": "dtFechaRegistro", "docNotaInventarioItem": None}


def laid_out_tables(spark: SparkSession, folder: str, buckets: int | None = None, per_bucket: int = 2_000_000) -> Tables:
    """The garment tables with stock notes laid out by month and both notes and lines in buckets of the note's id.

    The two tables are written once per application, in a schema of its own; the others are those of ``star_tables``.
    A task writes, and later joins, one bucket: without a number there are as many as ``per_bucket`` lines each ask
    for, at least 8.
    """
    flat = star_tables(spark, folder)
    if buckets is None:
        buckets = max(8, -(-flat["docNotaInventarioItem"].count() // per_bucket))
    own = f"{spark.sparkContext.applicationId}|{folder}|{buckets}"
    schema = f"spark_catalog.costurero_by_month_{crc32(own.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    conf = {name: {"frame": flat[name]} for name in TABLES}
    for name, instant in _LAID_OUT.items():
        conf[name] = {"table": f"{schema}.{name}"}
        if not spark.catalog.tableExists(conf[name]["table"]):
            lay_out(flat[name], conf[name]["table"], "IdDocumento_NotaInventario", buckets, instant)
    return Tables.from_conf(spark, conf)


def with_clauses(names: list[str]) -> str:
    """``WITH`` clauses that define ``names``, and all they read, for an ANSI database."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in STAR or name in ordered:
            return
        text = TEXTS[name].replace("EACH_CENTRE", EACH_CENTRE["ansi"])
        reads = inputs(text)
        for i in reads:
            add(i)
        ordered[name] = text.format(**{i: i for i in reads})

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({text})" for name, text in ordered.items())
