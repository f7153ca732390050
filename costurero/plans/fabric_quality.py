"""Fabric quality reports and the distribution of their measurements."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.histogram import percent_histogram
from costurero.operators.joins import with_master
from costurero.sources.registry import Tables

METRICS = ["DENSIDAD", "ANCHO_ACABADO", "REVIRADO", "ENCOG_ANCHO", "ENCOG_LARGO"]


def fabric_quality(
    tables: Tables,
    start: date | str,
    end: date | str,
    *,
    cliente: str = "",
    codigo: str = "",
    tela: str = "",
    color: str = "",
    acabado: str = "",
    partida: str = "",
) -> DataFrame:
    """Quality reports of a range of days; the searches are contains searches, so nulls never match."""
    reports = tables["docOrdenProduccionCalidad"].where(
        P.day_range("dtFechaReporte", start, end) & P.contains_ci("ntDescripcionAcabado", acabado)
    )
    reports = reports.withColumnsRenamed(
        {"IdDocumento_OrdenProduccion": "_report_of", "ntObservacion": "OBSERV2", "nvTituloObservacion": "OBSERV1"}
    )
    lots = (
        tables["docOrdenProduccion"]
        .where(P.contains_ci("CoddocOrdenProduccion", partida))
        .select(
            F.col("IdDocumento_OrdenProduccion").alias("_op"),
            F.col("CoddocOrdenProduccion").alias("PARTIDA"),
            F.col("nvDocumentoReferencia").alias("REF_PEDIDO"),
            "IdmaeColor",
            "IdmaeAnexo_Cliente",
        )
    )
    lots = with_master(
        lots, tables, "maecolor", "IdmaeColor", "idmaecolor", P.contains_ci("nommaecolor", color), COLOR="nommaecolor"
    )
    lots = with_master(
        lots,
        tables,
        "maeAnexoCliente",
        "IdmaeAnexo_Cliente",
        where=P.contains_ci("NommaeAnexoCliente", cliente),
        CLIENTE="NommaeAnexoCliente",
    )
    found = reports.join(lots, F.col("_report_of") == F.col("_op"))
    found = with_master(
        found,
        tables,
        "maeItemInventario",
        "idmaeitem",
        "IdmaeItem_Inventario",
        P.contains_ci("CodmaeItemInventario", codigo) & P.contains_ci("NommaeItemInventario", tela),
        CODIGO="CodmaeItemInventario",
        TELA="NommaeItemInventario",
    )
    return found.select(
        "PARTIDA",
        "REF_PEDIDO",
        F.col("CoddocOrdenProduccionCalidad").alias("REPORTE"),
        "CODIGO",
        "TELA",
        "COLOR",
        F.col("ntDescripcionAcabado").alias("ACABADO"),
        F.col("dAnchoAcabado").alias("ANCHO_ACABADO"),
        F.col("AATCC135_EncogLargo").alias("ENCOG_LARGO"),
        F.col("AATCC135_EncogAncho").alias("ENCOG_ANCHO"),
        F.col("AATCC179_ReviradoLavado").alias("REVIRADO"),
        F.col("AATCC179_DensidadAcabada").alias("DENSIDAD"),
        "OBSERV1",
        "OBSERV2",
        S.day_of(F.col("dtFechaReporte")).alias("FECH_REPORTE"),
        "CLIENTE",
    )


def quality_histogram(quality: DataFrame) -> DataFrame:
    """Percent histograms, 30 bins each, of the five measurements."""
    return percent_histogram(quality, {m: m for m in METRICS})
