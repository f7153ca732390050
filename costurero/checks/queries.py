"""Every operator and report as a named query over the star-schema folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costurero.functions import filters as P
from costurero.functions import scalars as S
from costurero.operators.aggregates import QTY, masked_sum
from costurero.operators.joins import filter_join
from costurero.operators.pivots import column
from costurero.plans import cut_by_client as CC
from costurero.plans import cut_progress as CP
from costurero.plans import fabric_quality as FQ
from costurero.plans import order_progress as OP
from costurero.plans import packages as PK
from costurero.plans import process_matrix as PM
from costurero.plans import schedule as SC
from costurero.schemas import TABLES
from costurero.session import tune
from costurero.sources.derived import catalog_tables, laid_out_tables, star_tables
from costurero.sources.registry import Tables
from costurero.sources.sinks import csv_lines, from_csv_lines

# Parameters: the first two years hold every planned day and every line, the others a typical page.
EVER = ("1995-01-01", "2002-12-31")
PLANNED = ("1996-01-01", "1996-12-31")
CUT = ("1997-01-01", "1997-12-31")
DELIVERED_AFTER = "2000-01-01"
MAX_UNITS = 40
PAGE = 3
TODAY = "1998-06-15"
CLIENT = "BUILDING Custom"
ONE_OS = "OS00000002"
ONE_ORDER = 1

_tables: dict[tuple[str, str], Tables] = {}


def tables_of(spark: SparkSession, folder: str) -> Tables:
    """The garment tables of a folder, once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _tables:
        tune(spark)
        _tables[key] = star_tables(spark, folder)
    return _tables[key]


def _floats(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the form in which the pages' frames hold quantities."""
    return df.select(
        *[
            column(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else column(f.name)
            for f in df.schema.fields
        ]
    )


def scan_counts(t: Tables) -> DataFrame:
    counts = [t[n].agg(F.count("*").alias("FILAS")).select(F.lit(n).alias("TABLA"), "FILAS") for n in TABLES]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


def filter_contains(t: Tables) -> DataFrame:
    return t["docOrdenVenta"].where(P.contains_ci("nvDocumentoReferencia", "PO-1")).select(
        "IdDocumento_OrdenVenta", "CoddocOrdenVenta", "nvDocumentoReferencia"
    )


def filter_contains_opt(t: Tables) -> DataFrame:
    return t["docOrdenVenta"].where(P.contains_ci_opt("nvDocumentoReferencia", "  ")).select(
        "IdDocumento_OrdenVenta", "CoddocOrdenVenta", "nvDocumentoReferencia"
    )


def filter_in_list(t: Tables) -> DataFrame:
    return t["maeItemInventario"].where(P.in_list("NommaeItemInventario", " red widget, ,blue bolt ")).select(
        "IdmaeItem_Inventario", "CodmaeItemInventario", "NommaeItemInventario"
    )


def filter_day_range(t: Tables) -> DataFrame:
    return t["docNotaInventario"].where(P.day_range("dtFechaRegistro", "1997-01-01", "1997-01-31")).select(
        "IdDocumento_NotaInventario", "dtFechaRegistro"
    )


def filter_instant_range(t: Tables) -> DataFrame:
    return t["docNotaInventario"].where(P.instant_range("dtFechaRegistro", "1997-01-01", "1997-01-31")).select(
        "IdDocumento_NotaInventario", "dtFechaRegistro"
    )


def month_bounds(t: Tables) -> DataFrame:
    first, last = P.month_bounds(S.day_of(F.col("dtFechaPlanea")))
    return t["docOrdenVenta"].groupBy(first.alias("DESDE"), last.alias("HASTA")).agg(F.count("*").alias("PEDIDOS"))


def domain_values(t: Tables) -> DataFrame:
    chosen = P.cascade(PM.process_summary(t, DELIVERED_AFTER), CLIENT)
    return P.domain(chosen, "PEDIDO")


def cascade_domains(t: Tables) -> DataFrame:
    return P.domains(PM.process_summary(t, DELIVERED_AFTER), CLIENT)


def scalar_pack(t: Tables) -> DataFrame:
    issued, planned = F.col("dtFechaEmision"), F.col("dtFechaPlanea")
    units, due = F.col("dCantidad"), F.col("dtFechaEntrega")
    id_ = F.col("IdDocumento_OrdenVenta")
    share = S.ratio(units, (id_ % 7) * 50000)
    return t["docOrdenVenta"].select(
        id_,
        S.whole(units - 50000.5).alias("ENTERO"),
        S.days_between(issued, planned + F.expr("INTERVAL 36 HOUR")).alias("DIAS"),
        S.day_of(planned).alias("DIA"),
        S.day_of_text(F.concat(F.lit("1996-02-"), (id_ % 31 + 1).cast("string"))).alias("DIA_TEXTO"),
        F.coalesce(F.col("nvDocumentoReferencia"), F.lit("")).alias("PO"),
        share.alias("RAZON"),
        S.guarded_ratio(id_ % 3, id_ % 5, id_ % 4).alias("RAZON_CON_GUARDA"),
        S.percent_label(share).alias("PORCENTAJE"),
        S.percent_text(share).alias("PORCENTAJE_ESPACIO"),
        S.day_month(due).alias("DIA_MES"),
        F.date_format(due, "dd").alias("DIA_NUMERO"),
        F.date_format(due, "MMM").alias("MES"),
        F.date_format(due, "dd_MMM").alias("EJE"),
        S.day_text(due).alias("FECHA"),
        S.first_chars(F.col("CoddocOrdenVenta"), 5).alias("IZQUIERDA"),
        S.last_chars(F.col("CoddocOrdenVenta"), 4).alias("DERECHA"),
        F.concat(F.col("CoddocOrdenVenta"), F.lit("_OP")).alias("UNIDO"),
        F.trim(F.concat(F.lit("  "), F.col("CoddocOrdenVenta"), F.lit(" "))).alias("RECORTADO"),
        F.greatest(share, F.lit(0.5)).alias("MAYOR"),
        F.least(share, F.lit(0.5)).alias("MENOR"),
        S.cap_at_one(share).alias("TOPE"),
        S.floor_at_zero(share - 1.0).alias("PISO"),
        (units * F.lit(1.075).cast("decimal(4,3)")).cast("double").alias("MARGEN"),
        S.thousands(S.whole(units)).alias("MILES"),
        F.to_timestamp_ntz(F.date_format(planned, "yyyy-MM-dd HH:mm:ss")).alias("MOMENTO"),
    )


def orders_planned(t: Tables) -> DataFrame:
    return OP.order_progress(t, *PLANNED, variant="planned", po="po")


def orders_progress_delivery(t: Tables) -> DataFrame:
    return OP.order_progress(t, *EVER, variant="delivery")


def orders_progress_list(t: Tables) -> DataFrame:
    return OP.order_progress(t, *EVER, variant="delivery", pedidos="PED00000010, PED00000016,, PED00000700 ")


def orders_status_pct(t: Tables) -> DataFrame:
    return OP.order_progress(t, *EVER, variant="status")


def orders_searched(t: Tables) -> DataFrame:
    return OP.order_progress(t, *EVER, variant="planned", pedido="ped0000", cliente="building")


def agg_masked_sum(t: Tables) -> DataFrame:
    items = t["docOrdenProduccionItem"]
    orders = t["docOrdenProduccion"].select(
        F.col("IdDocumento_OrdenProduccion").alias("_op"), "IdmaeAnexo_Cliente", "bCerrado", "bCierreAprobado"
    )
    joined = items.join(orders, F.col("IdDocumento_OrdenProduccion") == F.col("_op"))
    return joined.groupBy("IdmaeAnexo_Cliente").agg(
        F.sum("dCantidadProgramado").alias("TOTAL"),
        masked_sum(F.col("bCerrado"), F.col("dCantidadRequerido")).cast(QTY).alias("CERRADO"),
        (masked_sum(F.col("bCierreAprobado"), F.col("dCantidadProgramado")).cast(QTY) * F.lit(0.9).cast("decimal(1,1)")).alias("APROBADO"),
    )


def filter_joined(t: Tables) -> DataFrame:
    return filter_join(
        t["docOrdenProduccion"], t["docOrdenProduccionRuta"], "IdDocumento_OrdenProduccion"
    ).select("IdDocumento_OrdenProduccion", "CoddocOrdenProduccion", "IdtdDocumentoForm")


def agg_op_list(t: Tables) -> DataFrame:
    return CC.op_lists(CC.cut_orders(t, *EVER))


def op_list_pages(t: Tables) -> DataFrame:
    return CC.op_list_pages(CC.cut_orders(t, *EVER), PAGE)


def csv_roundtrip(t: Tables) -> DataFrame:
    listing = FQ.fabric_quality(t, *EVER)
    return from_csv_lines(csv_lines(listing), listing.schema)


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_counts": scan_counts,
    "csv_roundtrip": csv_roundtrip,
    "filter_contains": filter_contains,
    "filter_contains_opt": filter_contains_opt,
    "filter_in_list": filter_in_list,
    "filter_day_range": filter_day_range,
    "filter_instant_range": filter_instant_range,
    "month_bounds": month_bounds,
    "domain_values": domain_values,
    "cascade_domains": cascade_domains,
    "scalar_pack": scalar_pack,
    "filter_join": filter_joined,
    "agg_masked_sum": agg_masked_sum,
    "agg_op_list": agg_op_list,
    "op_list_pages": op_list_pages,
    "orders_progress": orders_planned,
    "orders_progress_delivery": orders_progress_delivery,
    "orders_progress_list": orders_progress_list,
    "orders_searched": orders_searched,
    "orders_status_pct": orders_status_pct,
    "orders_with_total": lambda t: OP.with_total(orders_planned(t), "planned"),
    "orders_status_with_total": lambda t: OP.with_total(orders_status_pct(t), "status"),
    "orders_totals": lambda t: OP.order_totals(orders_progress_delivery(t)),
    "orders_to_assemble_totals": lambda t: OP.sub_list_totals(orders_progress_delivery(t), "to_assemble"),
    "orders_to_dye_totals": lambda t: OP.sub_list_totals(orders_progress_delivery(t), "to_dye"),
    "orders_to_dispatch_totals": lambda t: OP.sub_list_totals(orders_progress_delivery(t), "to_dispatch"),
    "orders_counts": lambda t: OP.order_counts(orders_planned(t)),
    "orders_to_assemble": lambda t: OP.sub_list(orders_planned(t), "to_assemble"),
    "orders_to_dye": lambda t: OP.sub_list(orders_planned(t), "to_dye"),
    "orders_to_dispatch": lambda t: OP.sub_list(orders_planned(t), "to_dispatch"),
    "orders_status_to_assemble": lambda t: OP.sub_list(orders_status_pct(t), "to_assemble", "status"),
    "orders_status_to_dye": lambda t: OP.sub_list(orders_status_pct(t), "to_dye", "status"),
    "orders_status_to_dispatch": lambda t: OP.sub_list(orders_status_pct(t), "to_dispatch", "status"),
    "process_summary": lambda t: PM.process_summary(t, DELIVERED_AFTER),
    "process_matrix": lambda t: PM.process_report(t, DELIVERED_AFTER),
    "process_matrix_text": lambda t: PM.presentation(PM.process_report(t, DELIVERED_AFTER)),
    "matrix_filtered": lambda t: PM.process_report(t, DELIVERED_AFTER, CLIENT),
    "cut_progress": lambda t: CP.cut_progress(t, *PLANNED),
    "cut_progress_filtered": lambda t: CP.cut_progress(t, *EVER, cliente=" building "),
    "cut_progress_kpis": lambda t: CP.cut_progress_kpis(CP.cut_progress(t, *PLANNED)),
    "cut_orders": lambda t: CC.cut_orders(t, *EVER),
    "cut_orders_by_month": lambda t: CC.cut_orders(t, *CUT),
    "cut_by_client": lambda t: CC.cut_by_client_report(t, *CUT),
    "cut_by_client_kpis": lambda t: CC.cut_by_client_kpis(CC.cut_orders(t, *CUT)),
    "packages": lambda t: PK.packages(t, MAX_UNITS),
    "packages_one_os": lambda t: PK.packages(t, MAX_UNITS, ONE_OS),
    "packages_by_size": PK.packages_by_size,
    "packages_header": PK.packages_header,
    "packages_source": PK.package_source,
    "qc_report": lambda t: FQ.fabric_quality(t, *EVER),
    "qc_report_filtered": lambda t: FQ.fabric_quality(t, *PLANNED, cliente="building", tela="WIDGET", color="o"),
    "qc_report_searched": lambda t: FQ.fabric_quality(t, *EVER, codigo="it0", acabado="n", partida="000"),
    "qc_report_catalog": lambda t: FQ.fabric_quality(t, *PLANNED),
    "qc_histogram": lambda t: FQ.quality_histogram(FQ.fabric_quality(t, *EVER)),
    "gantt_schedule": lambda t: SC.schedule(t, TODAY),
    "gantt_one_order": lambda t: SC.schedule(t, TODAY, ONE_ORDER),
    "gantt_calendar": SC.schedule_calendar,
}


def run(name: str, tables: Tables) -> DataFrame:
    """The named query over any garment tables."""
    return _floats(_QUERIES[name](tables))


#: Queries whose tables are read by three-part names.
FROM_CATALOG = {"qc_report_catalog"}

#: Queries whose facts are laid out by month and in buckets.
LAID_OUT = {"cut_orders_by_month"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
        source = catalog_tables if name in FROM_CATALOG else laid_out_tables if name in LAID_OUT else tables_of
        return lambda spark, folder: run(name, source(tune(spark), folder))

    return {name: bind(name) for name in _QUERIES}
