"""The same results as plain SQL, for an independent database on the same files.

Each statement joins and groups the tables directly, without the reductions the Spark
plans make, and packages are cut by a loop instead of the closed form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from costurero.checks import queries as Q
from costurero.schemas import TABLES
from costurero.sources.derived import TEXTS, with_clauses

# The client prefixes of the derived tables and their processes, for pivots spelled out.
CLIENTS = ["AUTOMOBILE Cust", "BUILDING Custom", "FURNITURE Custo", "HOUSEHOLD Custo", "MACHINERY Custo"]
PROCESSES = ["CORTE", "COSTURA"]


@dataclass(frozen=True)
class Sql:
    """A statement: its final ``body`` after common tables ``ctes``."""

    body: str
    ctes: str = ""
    recursive: bool = False

    def text(self, derived: bool) -> str:
        """The statement, after the derived garment tables it mentions or over stored ones."""
        words = set(re.findall(r"\w+", self.ctes + " " + self.body))
        views = with_clauses([v for v in TEXTS if v in words]) if derived else ""
        clauses = ", ".join(c for c in (views, self.ctes) if c)
        head = "WITH RECURSIVE " if self.recursive else "WITH "
        return f"{head}{clauses} {self.body}" if clauses else self.body


def _statement(body: str, ctes: str = "", recursive: bool = False) -> Sql:
    return Sql(body, ctes, recursive)


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _whole(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


# Rounded as decimals: 87/320 is 0.271875 and rounds to 0.27188, which float rounding can miss.
def _pct(x: str, tail: str = "%") -> str:
    return f"CAST(CAST(round(CAST({x} * 100 AS DECIMAL(38,8))) AS BIGINT) AS VARCHAR) || '{tail}'"


def _guarded(prog: str, prod: str, req: str) -> str:
    share = f"CASE WHEN {prog} <> 0 THEN {_ratio(prod, req)} ELSE 0 END"
    return f"CAST(round(CAST({share} AS DECIMAL(38,12)), 5) AS DOUBLE)"


def _days(start: str, end: str) -> str:
    return f"CAST(round(date_diff('second', {start}, {end}) / 86400.0) AS INTEGER)"


# --- sales orders -------------------------------------------------------------------------

def _orders(
    span: tuple[str, str], variant: str, po: str = "", codes: list[str] | None = None, code: str = "", client: str = ""
) -> str:
    """CTEs that end in ``progreso``: one row per order of the page, every measure."""
    shown = "dtFechaEntrega" if variant == "delivery" else "dtFechaPlanea"
    fabric_void = "" if variant == "delivery" else "AND op.bAnulado = 0"
    open_only = "" if variant == "status" else "AND op.bCerrado = 0"
    delivery = "AND v.dtFechaEntrega IS NOT NULL" if variant == "status" else ""
    listed = f"AND v.CoddocOrdenVenta IN ({', '.join(repr(c) for c in codes)})" if codes else ""
    kg = "coalesce(k.kg, 0)"
    ap, de = _ratio("t.aprobado", kg), _ratio("t.despachado", kg)
    cap = "CASE WHEN {0} > 1 THEN 1 ELSE {0} END"
    left = f"round(({cap.format(ap)}) * CAST(u.prog AS DOUBLE) - CAST(u.cortado AS DOUBLE), 6)"
    return f"""
    pedido_kg AS (
        SELECT IdDocumento_Referencia AS pedido_id, SUM(dCantidad) AS kg FROM docOrdenVentaItem
        WHERE IdDocumento_Referencia > 0 GROUP BY ALL),
    pedido_tela AS (
        SELECT vi.IdDocumento_Referencia AS pedido_id, SUM(pi.dCantidadProgramado) AS armado,
               SUM(op.bCerrado * pi.dCantidadRequerido) AS despachado,
               SUM(r.bCerrado * pi.dCantidadProgramado) AS tenido,
               SUM(op.bCierreAprobado * pi.dCantidadProgramado * 0.9) AS aprobado
        FROM docOrdenProduccion op
        JOIN docOrdenProduccionRuta r ON r.IdDocumento_OrdenProduccion = op.IdDocumento_OrdenProduccion AND r.IdmaeReceta > 0
        JOIN docOrdenProduccionItem pi ON pi.IdDocumento_OrdenProduccion = op.IdDocumento_OrdenProduccion
        JOIN docOrdenVentaItem vi ON vi.IdDocumento_OrdenVenta = op.IdDocumento_Referencia AND vi.IdmaeItem = pi.IdmaeItem
        WHERE TRUE {fabric_void} GROUP BY ALL),
    prenda AS (
        SELECT op.IdDocumento_OrdenProduccion AS op_id, v.IdDocumento_OrdenVenta AS pedido_id
        FROM docOrdenProduccion op JOIN docOrdenVenta v ON v.IdDocumento_OrdenVenta = op.IdDocumento_Referencia
        WHERE op.IdtdDocumentoForm = 127 AND op.bAnulado = 0 {open_only}),
    centro AS (SELECT IdmaeCentroCosto AS centro_id FROM maeCentroCosto WHERE bConOrdenProduccion = 1),
    programado AS (
        SELECT p.pedido_id, SUM(i.dCantidadProgramado) AS prog
        FROM prenda p
        JOIN docOrdenProduccionRuta r ON r.IdDocumento_OrdenProduccion = p.op_id AND r.IdmaeCentroCosto = 29
        JOIN centro c ON c.centro_id = r.IdmaeCentroCosto
        JOIN docOrdenProduccionItem i ON i.IdDocumento_OrdenProduccion = p.op_id
        GROUP BY ALL),
    movido AS (
        SELECT p.pedido_id, SUM(l.dCantidadIng) FILTER (WHERE n.IdmaeCentroCosto = 29) AS cortado,
               SUM(l.dCantidadIng) FILTER (WHERE n.IdmaeCentroCosto = 47) AS cosido
        FROM docNotaInventario n
        JOIN centro c ON c.centro_id = n.IdmaeCentroCosto
        JOIN docNotaInventarioItem l ON l.IdDocumento_NotaInventario = n.IdDocumento_NotaInventario
        JOIN prenda p ON p.op_id = n.IdDocumento_OrdenProduccion
        JOIN docOrdenProduccionRuta r ON r.IddocOrdenProduccionRuta = n.IddocOrdenProduccionRuta
        JOIN docOrdenProduccionItem i ON i.IdDocumento_OrdenProduccion = p.op_id AND i.IdmaeItem = l.IdmaeItem_Inventario
        JOIN maeItemInventario m ON m.IdmaeItem_Inventario = l.IdmaeItem_Inventario AND m.IdtdItemForm = 10
        WHERE n.IdtdDocumentoForm = 131 AND n.bDevolucion + n.bDesactivado + n.bAnulado = 0
          AND n.IdDocumento_OrdenProduccion <> 0 AND l.dCantidadIng <> 0
        GROUP BY ALL),
    unidades AS (
        SELECT v.CoddocOrdenVenta AS codigo, coalesce(prog, 0) AS prog, coalesce(cortado, 0) AS cortado,
               coalesce(cosido, 0) AS cosido
        FROM docOrdenVenta v
        LEFT JOIN programado g ON g.pedido_id = v.IdDocumento_OrdenVenta
        LEFT JOIN movido w ON w.pedido_id = v.IdDocumento_OrdenVenta),
    progreso AS (
        SELECT v.CoddocOrdenVenta AS "PEDIDO", CAST(v.dtFechaEmision AS DATE) AS "F_EMISION",
               CAST(v.{shown} AS DATE) AS "F_ENTREGA", {_days('v.dtFechaEmision', f'v.{shown}')} AS "DIAS",
               left(c.NommaeAnexoCliente, 15) AS "CLIENTE", v.nvDocumentoReferencia AS "PO",
               {_whole('v.dCantidad')} AS "UNID", {_whole(kg)} AS "KG_REQ", {_whole('t.armado')} AS "KG_ARM",
               {_whole(f'{kg} * 1.075 - t.armado')} AS "KG_X_ARM", {_whole('t.tenido')} AS "KG_TEÑIDOS",
               {_whole('t.armado - t.tenido')} AS "KG_ARM_X_TEÑIR", {_whole('t.despachado')} AS "KG_DESPACH",
               {_whole('t.aprobado')} AS "KG_APROB_D", {_whole(f'{kg} - t.despachado')} AS "KG_X_DESPACH",
               {de} * 100 AS "R", {_pct(_ratio('t.armado', kg))} AS "R1", {_whole('u.prog')} AS "PROG",
               {_whole('u.cortado')} AS "CORTADO", {_whole('u.cosido')} AS "COSIDO",
               {_pct(_ratio('t.armado', kg))} AS "KG_ARMP",
               {_pct(_ratio(f'{kg} * 1.075 - t.armado', kg))} AS "KG_X_ARMP",
               {_pct(_ratio('t.tenido', kg))} AS "KG_TEÑIDOSP",
               {_pct(_ratio('t.armado - t.tenido', kg))} AS "KG_ARM_X_TEÑIRP",
               {_pct(de)} AS "KG_DESPACHP", {_pct(ap)} AS "KG_APROB_DP",
               {_pct(_ratio(f'{kg} - t.despachado', kg))} AS "KG_X_DESPACHP",
               {_pct(_ratio('u.prog', 'v.dCantidad'))} AS "PROGP",
               {_pct(_ratio('u.cortado', 'v.dCantidad'))} AS "CORTADOP",
               {_pct(_ratio('u.cosido', 'v.dCantidad'))} AS "COSIDOP",
               greatest({ap}, {de}) AS disp_tela,
               {cap.format(f'greatest({ap}, {de})')} AS disp_ajuste,
               CAST(u.cortado AS DOUBLE) AS "CORTADO_DEC",
               ({cap.format(f'least({ap}, {de})')}) * CAST(u.prog AS DOUBLE) AS puede_cortar,
               {_whole(f'CASE WHEN {left} < 0 THEN 0 ELSE {left} END')} AS con_tela
        FROM docOrdenVenta v
        JOIN maeAnexoCliente c ON c.IdmaeAnexo_Cliente = v.IdmaeAnexo_Cliente
        LEFT JOIN pedido_kg k ON k.pedido_id = v.IdDocumento_OrdenVenta
        LEFT JOIN pedido_tela t ON t.pedido_id = v.IdDocumento_OrdenVenta
        LEFT JOIN unidades u ON u.codigo = v.CoddocOrdenVenta
        WHERE v.IdtdDocumentoForm = 10 AND v.IdtdTipoVenta = 4 AND v.bAnulado = 0 {delivery} {listed}
          AND CAST(v.{shown} AS DATE) BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'
          AND v.nvDocumentoReferencia ILIKE '%{po}%' AND v.CoddocOrdenVenta ILIKE '%{code}%'
          AND c.NommaeAnexoCliente ILIKE '%{client}%')"""


_MAIN = [
    "PEDIDO", "F_EMISION", "F_ENTREGA", "DIAS", "CLIENTE", "PO", "UNID", "KG_REQ", "KG_ARM", "KG_X_ARM",
    "KG_TEÑIDOS", "KG_ARM_X_TEÑIR", "KG_DESPACH", "KG_APROB_D", "KG_X_DESPACH", "R",
]
_ORDER_OUTPUT = [*_MAIN, "R1", "PROG", "CORTADO", "COSIDO"]
_STATUS_OUTPUT = [
    *_MAIN, "PROG", "CORTADO", "COSIDO", "KG_ARMP", "KG_X_ARMP", "KG_TEÑIDOSP", "KG_ARM_X_TEÑIRP", "KG_DESPACHP",
    "KG_APROB_DP", "KG_X_DESPACHP", "PROGP", "CORTADOP", "COSIDOP", "disp_tela", "disp_ajuste", "CORTADO_DEC",
    "puede_cortar", "con_tela",
]
_TEXTS = {"PEDIDO", "CLIENTE", "PO", "R1"}
_DATES = {"F_EMISION", "F_ENTREGA"}
_TODO = {
    "to_assemble": '("KG_X_ARM" > 0 OR "KG_X_ARM" IS NULL)',
    "to_dye": '"KG_ARM_X_TEÑIR" > 0',
    "to_dispatch": '("R" < 97.5 OR "R" IS NULL)',
}


def _names(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def _sum_or_null(column: str) -> str:
    if column in _DATES:
        return f'CAST(NULL AS DATE) AS "{column}"'
    if column in _TEXTS or column.endswith("P"):
        return f'CAST(NULL AS VARCHAR) AS "{column}"'
    return f'CAST(SUM("{column}") AS BIGINT) AS "{column}"'


def _totals(columns: list[str], where: str = "TRUE") -> str:
    cells = [f"'Total' AS \"{c}\"" if c in _TEXTS | _DATES else _sum_or_null(c) for c in columns]
    return f"SELECT {', '.join(cells)} FROM progreso WHERE {where}"


def _with_total(columns: list[str], where: str = "TRUE") -> str:
    sums = ", ".join(_sum_or_null(c) for c in columns)
    return (
        f"SELECT {_names(columns)}, 0 AS is_total FROM progreso WHERE {where} "
        f"UNION ALL SELECT {sums}, 1 FROM progreso WHERE {where}"
    )


def _order_statements() -> dict[str, Sql]:
    from costurero.plans.constants import LIST_COLUMNS, ORDER_COLUMNS

    planned = _orders(Q.PLANNED, "planned", po="po")
    delivery = _orders(Q.EVER, "delivery")
    status = _orders(Q.EVER, "status")
    counts = ", ".join(f"COUNT(*) FILTER (WHERE {w}) AS {n.upper()}" for n, w in _TODO.items())
    codes = ["PED00000010", "PED00000016", "PED00000700"]
    out = {
        "orders_progress": _statement(f"SELECT {_names(_ORDER_OUTPUT)} FROM progreso", planned),
        "orders_progress_delivery": _statement(f"SELECT {_names(_ORDER_OUTPUT)} FROM progreso", delivery),
        "orders_progress_list": _statement(
            f"SELECT {_names(_ORDER_OUTPUT)} FROM progreso", _orders(Q.EVER, "delivery", codes=codes)
        ),
        "orders_searched": _statement(
            f"SELECT {_names(_ORDER_OUTPUT)} FROM progreso", _orders(Q.EVER, "planned", code="ped0000", client="building")
        ),
        "orders_status_pct": _statement(f"SELECT {_names(_STATUS_OUTPUT)} FROM progreso", status),
        "orders_with_total": _statement(_with_total(ORDER_COLUMNS["planned"]), planned),
        "orders_status_with_total": _statement(_with_total(ORDER_COLUMNS["status"]), status),
        "orders_totals": _statement(_totals(ORDER_COLUMNS["delivery"]), delivery),
        "orders_counts": _statement(f'SELECT COUNT(*) AS "PEDIDOS", {counts} FROM progreso', planned),
    }
    for name, where in _TODO.items():
        out[f"orders_{name}"] = _statement(_with_total(LIST_COLUMNS["kilos"][name], where), planned)
        out[f"orders_{name}_totals"] = _statement(_totals(LIST_COLUMNS["kilos"][name], where), delivery)
        out[f"orders_status_{name}"] = _statement(_with_total(LIST_COLUMNS["status"][name], where), status)
    return out


# --- processes and cuts -------------------------------------------------------------------

_RESUMEN = f"""
    resumen AS (
        SELECT v.CoddocOrdenVenta AS "PEDIDO", op.CoddocOrdenProduccion AS "OP", ce.NommaeCentroCosto AS "PROCESO",
               co.NommaeCombo AS "COMBO", cl.NommaeAnexoCliente AS cliente_completo, es.nvModelo AS "ESTILO",
               SUM(a.dCantidadRequerido) AS req, SUM(a.dCantidadProgramado) AS prog, SUM(a.dCantidadProducido) AS prod
        FROM docOrdenProduccion op
        JOIN docOrdenVenta v ON v.IdDocumento_OrdenVenta = op.IdDocumento_Referencia
        JOIN maeAnexoCliente cl ON cl.IdmaeAnexo_Cliente = op.IdmaeAnexo_Cliente
        JOIN maeEstilo es ON es.IdmaeEstilo = op.IdmaeEstilo
        JOIN avanceComboTalla a ON a.IdDocumento_OrdenProduccion = op.IdDocumento_OrdenProduccion
        JOIN maeTalla ta ON ta.IdmaeTalla = a.IdmaeTalla
        JOIN maeCombo co ON co.IdmaeCombo = a.IdmaeCombo
        JOIN maeCentroCosto ce ON ce.IdmaeCentroCosto = a.IdmaeCentroCosto
        JOIN docOrdenProduccionRuta ru ON ru.IddocOrdenProduccionRuta = a.IddocOrdenProduccionRuta
        WHERE op.dtFechaEntrega > TIMESTAMP '{Q.DELIVERED_AFTER}'
        GROUP BY ALL)"""


def _matrix(where: str = "TRUE", shown: str = "CAST({} AS DOUBLE)") -> Sql:
    cells = ", ".join(
        shown.format(f"coalesce(SUM({m}) FILTER (WHERE \"PROCESO\" = '{p}'), 0)") + f' AS "{p} ({label})"'
        for p in PROCESSES
        for m, label in (("req", "Req"), ("prod", "Prod"))
    )
    return _statement(
        f'SELECT "PEDIDO", "OP", left(cliente_completo, 15) AS "CLIENTE", "ESTILO", "COMBO", {cells} '
        f"FROM resumen WHERE {where} GROUP BY ALL",
        _RESUMEN,
    )


def _cut(span: tuple[str, str], where: str = "TRUE") -> str:
    return f"""
    corte AS (
        SELECT op.CoddocOrdenProduccion AS "OP", ce.NommaeCentroCosto AS "PROCESO", co.NommaeCombo AS "COMBO",
               strftime(op.dtFechaEntrega, '%d-%b') AS "F_ENTREGA", left(cl.NommaeAnexoCliente, 15) AS "CLIENTE",
               v.CoddocOrdenVenta AS "PEDIDO", strftime(v.dtFechaPlanea, '%d-%b') AS "F_PLAN",
               left(es.nvModelo, 15) AS "ESTILO", CAST(a.dCantidadRequerido AS DOUBLE) AS "REQUERI",
               CAST(a.dCantidadProgramado AS DOUBLE) AS "PROG", CAST(a.dCantidadProducido AS DOUBLE) AS "PRODUC",
               CAST(a.dCantidadProgramado - a.dCantidadProducido AS DOUBLE) AS "PENDIENTE",
               {_pct(_guarded('a.dCantidadProgramado', 'a.dCantidadProducido', 'a.dCantidadRequerido'), ' %')} AS "PORCENT"
        FROM docOrdenVenta v
        JOIN docOrdenProduccion op ON op.IdDocumento_Referencia = v.IdDocumento_OrdenVenta
        JOIN maeAnexoCliente cl ON cl.IdmaeAnexo_Cliente = op.IdmaeAnexo_Cliente
        JOIN maeEstilo es ON es.IdmaeEstilo = op.IdmaeEstilo
        JOIN avanceCombo a ON a.IdDocumento_OrdenProduccion = op.IdDocumento_OrdenProduccion
        JOIN maeCombo co ON co.IdmaeCombo = a.IdmaeCombo
        JOIN maeCentroCosto ce ON ce.IdmaeCentroCosto = a.IdmaeCentroCosto
        JOIN docOrdenProduccionRuta ru ON ru.IddocOrdenProduccionRuta = a.IddocOrdenProduccionRuta
        WHERE ce.IdmaeCentroCosto = 29 AND {where}
          AND v.dtFechaPlanea BETWEEN TIMESTAMP '{span[0]}' AND TIMESTAMP '{span[1]}')"""


def _notes(span: tuple[str, str]) -> str:
    return f"""
    cortes AS (
        SELECT CAST(n.dtFechaRegistro AS DATE) AS "DIA", left(cl.NommaeAnexoCliente, 15) AS "CLIENTE",
               op.CoddocOrdenProduccion AS "OP", {_whole('l.dCantidadIng')} AS unid
        FROM docNotaInventario n
        JOIN docNotaInventarioItem l ON l.IdDocumento_NotaInventario = n.IdDocumento_NotaInventario
        JOIN docOrdenProduccion op ON op.IdDocumento_OrdenProduccion = n.IdDocumento_OrdenProduccion
        JOIN maeAnexoCliente cl ON cl.IdmaeAnexo_Cliente = op.IdmaeAnexo_Cliente
        WHERE l.dCantidadIng <> 0 AND op.bCerrado + op.bAnulado = 0 AND op.IdtdDocumentoForm = 127
          AND n.IdtdDocumentoForm = 131 AND n.bDevolucion + n.bDesactivado + n.bAnulado = 0
          AND n.IdDocumento_OrdenProduccion <> 0 AND n.IdmaeCentroCosto = 29
          AND n.dtFechaRegistro BETWEEN TIMESTAMP '{span[0]}' AND TIMESTAMP '{span[1]}')"""


def _process_statements() -> dict[str, Sql]:
    summary = f"""SELECT "PEDIDO", "OP", "PROCESO", "COMBO", left(cliente_completo, 15) AS "CLIENTE", "ESTILO",
        CAST(req AS DOUBLE) AS "Q_REQ", CAST(prog AS DOUBLE) AS "Q_PROG", CAST(prod AS DOUBLE) AS "Q_PROD",
        CAST(prog - prod AS DOUBLE) AS "Q_PEND", {_guarded('prog', 'prod', 'req')} AS "AVANCE_PORC" FROM resumen"""
    of_client = f"left(cliente_completo, 15) = '{Q.CLIENT}'"
    lists = "string_agg(DISTINCT \"OP\", ', ' ORDER BY \"OP\")"
    pivot = ", ".join(
        f"coalesce(CAST(SUM(unid) FILTER (WHERE \"CLIENTE\" = '{c}') AS BIGINT), 0) AS \"{c}\", "
        f"coalesce({lists} FILTER (WHERE \"CLIENTE\" = '{c}'), '') AS \"{c}_OP\""
        for c in CLIENTS
    )
    kpis = """SELECT COUNT(*) AS "REGISTROS", SUM("REQUERI") AS "TOTAL_REQUERIDO", SUM("PRODUC") AS "TOTAL_PRODUCIDO",
        SUM("PENDIENTE") AS "TOTAL_PENDIENTE" FROM corte"""
    return {
        "process_summary": _statement(summary, _RESUMEN),
        "process_matrix": _matrix(),
        "process_matrix_text": _matrix(shown="format('{{:,}}', CAST(round_even({}, 0) AS BIGINT))"),
        "matrix_filtered": _matrix(of_client),
        "domain_values": _statement(f'SELECT DISTINCT "PEDIDO" FROM resumen WHERE {of_client}', _RESUMEN),
        "cascade_domains": _statement(
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"NIVEL\", \"{c}\" AS \"VALOR\", COUNT(*) AS \"FILAS\" FROM opciones WHERE {w} GROUP BY ALL"
                for c, w in (("CLIENTE", "TRUE"), ("PEDIDO", f"\"CLIENTE\" = '{Q.CLIENT}'"), ("OP", f"\"CLIENTE\" = '{Q.CLIENT}'"))
            ),
            _RESUMEN + ', opciones AS (SELECT left(cliente_completo, 15) AS "CLIENTE", "PEDIDO", "OP" FROM resumen)',
        ),
        "cut_progress": _statement("SELECT * FROM corte", _cut(Q.PLANNED)),
        "cut_progress_filtered": _statement(
            "SELECT * FROM corte", _cut(Q.EVER, "cl.NommaeAnexoCliente ILIKE '%building%'")
        ),
        "cut_progress_kpis": _statement(kpis, _cut(Q.PLANNED)),
        "agg_op_list": _statement(
            f'SELECT "DIA", "CLIENTE", CAST(SUM(unid) AS BIGINT) AS "UNID", {lists} AS "OPS" FROM cortes GROUP BY ALL',
            _notes(Q.EVER),
        ),
        "op_list_pages": _statement(
            'SELECT "DIA", "CLIENTE", "PAGINA", string_agg("OP", \', \' ORDER BY "OP") AS "OPS" FROM paginas GROUP BY ALL',
            _notes(Q.EVER)
            + ', paginas AS (SELECT "DIA", "CLIENTE", "OP", CAST((row_number() OVER (PARTITION BY "DIA", "CLIENTE" ORDER BY "OP") - 1) '
            f'// {Q.PAGE} + 1 AS BIGINT) AS "PAGINA" FROM (SELECT DISTINCT "DIA", "CLIENTE", "OP" FROM cortes) AS ops)',
        ),
        "cut_orders": _statement(
            'SELECT "DIA", "CLIENTE", "OP", CAST(SUM(unid) AS BIGINT) AS "UNID" FROM cortes GROUP BY ALL', _notes(Q.EVER)
        ),
        "cut_orders_by_month": _statement(
            'SELECT "DIA", "CLIENTE", "OP", CAST(SUM(unid) AS BIGINT) AS "UNID" FROM cortes GROUP BY ALL', _notes(Q.CUT)
        ),
        "cut_by_client": _statement(
            f"SELECT strftime(\"DIA\", '%d-%m-%Y') AS \"FECHA\", {pivot}, CAST(SUM(unid) AS BIGINT) AS \"TOTAL\" "
            'FROM cortes GROUP BY "DIA"',
            _notes(Q.CUT),
        ),
        "cut_by_client_kpis": _statement(
            'SELECT COUNT(DISTINCT "DIA") AS "DIAS", CAST(coalesce(SUM(unid), 0) AS BIGINT) AS "UNIDADES", '
            f'coalesce({_ratio("SUM(unid)", "COUNT(DISTINCT DIA)")}, 0) AS "PROMEDIO" FROM cortes',
            _notes(Q.CUT),
        ),
    }


# --- packages -----------------------------------------------------------------------------

_LINEAS = """
    servicio AS (
        SELECT 'T' AS clase, IdDocumento_OrdenTrabajo AS os_id, CoddocOrdenTrabajo AS "OS",
               IdDocumento_Referencia AS op_id, ntObservacion AS "OBS"
        FROM docOrdenTrabajo WHERE IdmaeCentroCosto = 29
        UNION ALL
        SELECT 'C', IdDocumento_OrdenCompra, CoddocOrdenCompra, IdDocumento_Referencia, ntObservacion
        FROM docOrdenCompra WHERE IdmaeCentroCosto = 29),
    material AS (
        SELECT 'T' AS clase, IdDocumento_OrdenTrabajo AS os_id, right(ntDescripcion, 35) AS "MP" FROM docOrdentrabajoItem
        UNION ALL SELECT 'C', IdDocumento_OrdenCompra, right(ntDescripcion, 35) FROM docOrdenCompraItem),
    linea AS (
        SELECT 'T' AS clase, IdDocumento_OrdenTrabajo AS os_id, IdmaeItem AS item, idmaecombo AS combo,
               IdmaeTalla AS talla, dCantidad AS "CANTIDAD" FROM docOrdenTrabajoProduccion
        UNION ALL
        SELECT 'C', IdDocumento_OrdenCompra, IdmaeItem, idmaecombo, IdmaeTalla, dCantidad FROM docOrdenCompraProduccion),
    fuente AS (
        SELECT v.CoddocOrdenVenta AS "PEDIDO", cl.NommaeAnexoCliente AS "CLIENTE", v.nvDocumentoReferencia AS "PO",
               op.CoddocOrdenProduccion AS "OP", s."OS", es.NommaeEstilo AS "ESTILO", co.NommaeCombo AS "COMBO",
               s."OBS", m."MP", ta.NommaeTalla AS "TALLA", ta.iSecuencia AS "ORDEN_TALLA", l."CANTIDAD", l.item, l.combo
        FROM linea l
        JOIN servicio s ON s.clase = l.clase AND s.os_id = l.os_id
        JOIN material m ON m.clase = l.clase AND m.os_id = l.os_id
        JOIN docOrdenProduccion op ON op.IdDocumento_OrdenProduccion = s.op_id
        JOIN docOrdenVenta v ON v.IdDocumento_OrdenVenta = op.IdDocumento_Referencia
        JOIN maeAnexoCliente cl ON cl.IdmaeAnexo_Cliente = v.IdmaeAnexo_Cliente
        JOIN maeItemInventario i ON i.IdmaeItem_Inventario = l.item
        JOIN maeEstilo es ON es.IdmaeEstilo = i.IdmaeEstilo
        JOIN maeCombo co ON co.IdmaeCombo = l.combo
        JOIN maeTalla ta ON ta.IdmaeTalla = l.talla)"""


def _package_statements() -> dict[str, Sql]:
    m = Q.MAX_UNITS
    take = f"CASE WHEN {{0}} <= {m} OR {{0}} - {m} < 10 THEN {{0}} ELSE {m} END"
    loop = f"""{_LINEAS},
    fila AS (
        SELECT "OS", "ORDEN_TALLA", trim("TALLA") AS talla, {_whole('"CANTIDAD"')} AS q, row_number() OVER () AS copia
        FROM fuente),
    paquete AS (
        SELECT "OS", "ORDEN_TALLA", talla, q, copia, q AS resto, {take.format('q')} AS unidades, CAST(1 AS BIGINT) AS ini
        FROM fila WHERE q > 0
        UNION ALL
        SELECT "OS", "ORDEN_TALLA", talla, q, copia, resto - unidades, {take.format('(resto - unidades)')}, ini + unidades
        FROM paquete WHERE resto - unidades > 0)"""
    header = ["PEDIDO", "CLIENTE", "PO", "OP", "ESTILO", "COMBO", "OBS", "MP"]
    ties = ", ".join(f'"{c}" DESC NULLS LAST' for c in header)
    numbered = """SELECT "OS", row_number() OVER (PARTITION BY "OS" ORDER BY "ORDEN_TALLA", talla, q, copia, ini) AS "#",
        talla AS "TALLA", unidades AS "CANTIDAD", ini AS "Prenda Ini", ini + unidades - 1 AS "Prenda Fin"
        FROM paquete"""
    return {
        "packages": _statement(numbered, loop, recursive=True),
        "packages_one_os": _statement(f"""{numbered} WHERE "OS" = '{Q.ONE_OS}'""", loop, recursive=True),
        "packages_by_size": _statement(
            'SELECT "OS", talla AS "TALLA", CAST(SUM(unidades) AS BIGINT) AS "CANTIDAD" FROM paquete GROUP BY ALL',
            loop,
            recursive=True,
        ),
        "packages_header": _statement(
            f'SELECT "OS", {_names(header)} FROM fuente QUALIFY row_number() OVER '
            f'(PARTITION BY "OS" ORDER BY "ORDEN_TALLA" DESC, item DESC, combo DESC, {ties}) = 1',
            _LINEAS,
        ),
        "packages_source": _statement(
            'SELECT "PEDIDO", "CLIENTE", "PO", "OP", "OS", "ESTILO", "COMBO", "OBS", "MP", "TALLA", "ORDEN_TALLA", '
            'CAST("CANTIDAD" AS DOUBLE) AS "CANTIDAD" FROM fuente',
            _LINEAS,
        ),
    }


# --- fabric quality and schedule ----------------------------------------------------------

def _quality(
    span: tuple[str, str], cliente: str = "", tela: str = "", color: str = "", codigo: str = "", acabado: str = "", partida: str = ""
) -> str:
    # An empty search still needs a text to search in: LIKE '%%' is null for null.
    return f"""
    calidad AS (
        SELECT op.CoddocOrdenProduccion AS "PARTIDA", op.nvDocumentoReferencia AS "REF_PEDIDO",
               q.CoddocOrdenProduccionCalidad AS "REPORTE", i.CodmaeItemInventario AS "CODIGO",
               i.NommaeItemInventario AS "TELA", co.nommaecolor AS "COLOR", q.ntDescripcionAcabado AS "ACABADO",
               q.dAnchoAcabado AS "ANCHO_ACABADO", q.AATCC135_EncogLargo AS "ENCOG_LARGO",
               q.AATCC135_EncogAncho AS "ENCOG_ANCHO", q.AATCC179_ReviradoLavado AS "REVIRADO",
               q.AATCC179_DensidadAcabada AS "DENSIDAD", q.nvTituloObservacion AS "OBSERV1",
               q.ntObservacion AS "OBSERV2", CAST(q.dtFechaReporte AS DATE) AS "FECH_REPORTE",
               cl.NommaeAnexoCliente AS "CLIENTE"
        FROM docOrdenProduccionCalidad q
        JOIN docOrdenProduccion op ON op.IdDocumento_OrdenProduccion = q.IdDocumento_OrdenProduccion
        JOIN maeItemInventario i ON i.IdmaeItem_Inventario = q.idmaeitem
        JOIN maecolor co ON co.idmaecolor = op.IdmaeColor
        JOIN maeAnexoCliente cl ON cl.IdmaeAnexo_Cliente = op.IdmaeAnexo_Cliente
        WHERE CAST(q.dtFechaReporte AS DATE) BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'
          AND cl.NommaeAnexoCliente ILIKE '%{cliente}%' AND i.NommaeItemInventario ILIKE '%{tela}%'
          AND co.nommaecolor ILIKE '%{color}%' AND i.CodmaeItemInventario ILIKE '%{codigo}%'
          AND q.ntDescripcionAcabado ILIKE '%{acabado}%' AND op.CoddocOrdenProduccion ILIKE '%{partida}%')"""


def _quality_statements() -> dict[str, Sql]:
    metrics = ["DENSIDAD", "ANCHO_ACABADO", "REVIRADO", "ENCOG_ANCHO", "ENCOG_LARGO"]
    values = " UNION ALL ".join(f"SELECT '{m}' AS metric, \"{m}\" AS x FROM calidad" for m in metrics)
    step = "((hi - lo) / 30.0::DOUBLE)"
    histogram = f"""
    valor AS (SELECT metric, x FROM ({values}) WHERE x IS NOT NULL),
    extremo AS (
        SELECT metric, COUNT(*) AS total, MIN(x) - CASE WHEN MIN(x) = MAX(x) THEN 0.5 ELSE 0 END AS lo,
               MAX(x) + CASE WHEN MIN(x) = MAX(x) THEN 0.5 ELSE 0 END AS hi
        FROM valor GROUP BY metric),
    banda AS (
        SELECT metric, total, i, i * {step} + lo AS desde, CASE WHEN i = 29 THEN hi ELSE (i + 1) * {step} + lo END AS hasta
        FROM extremo, range(30) AS r(i))"""
    listing = _statement("SELECT * FROM calidad", _quality(Q.EVER))
    return {
        "qc_report": listing,
        "csv_roundtrip": listing,
        "qc_report_catalog": _statement("SELECT * FROM calidad", _quality(Q.PLANNED)),
        "qc_report_filtered": _statement(
            "SELECT * FROM calidad",
            _quality(Q.PLANNED, cliente="building", tela="WIDGET", color="o"),
        ),
        "qc_report_searched": _statement(
            "SELECT * FROM calidad", _quality(Q.EVER, codigo="it0", acabado="n", partida="000")
        ),
        "qc_histogram": _statement(
            """SELECT b.metric AS "METRIC", CAST(b.i AS INTEGER) AS "BIN", b.desde AS "DESDE", b.hasta AS "HASTA",
            COUNT(v.x) AS "N", COUNT(v.x)::DOUBLE / b.total::DOUBLE * 100 AS "PORCENTAJE"
            FROM banda b LEFT JOIN valor v
              ON v.metric = b.metric AND v.x >= b.desde AND (v.x < b.hasta OR (b.i = 29 AND v.x <= b.hasta))
            GROUP BY b.metric, b.i, b.desde, b.hasta, b.total""",
            _quality(Q.EVER) + "," + histogram,
        ),
    }


def _schedule_statements() -> dict[str, Sql]:
    elapsed = f"floor(date_diff('second', r.Fecha_Inicial_Programada, TIMESTAMP '{Q.TODAY}') / 86400.0)"
    plan = f"""
    plan AS (
        SELECT p.*, r.* EXCLUDE (Id_Pedido),
               CASE WHEN {elapsed} < 0 THEN 0
                    WHEN {_ratio(elapsed, 'r.Tiempo')} * 100 > 100 THEN 100
                    ELSE {_ratio(elapsed, 'r.Tiempo')} * 100 END AS esperado
        FROM Pedido p JOIN Proceso r ON r.Id_Pedido = p.Id_Pedido)"""
    bars = """SELECT Id_Pedido, Nompedido, Fecha_Emision, Fecha_Entrega, CAST(Id_Proceso AS BIGINT) AS Id_Proceso,
            Fecha_Inicial_Programada AS "INICIO", Fecha_Inicial_Programada + Tiempo * INTERVAL '1' DAY AS "FIN",
            Tiempo AS "DIAS", Porcentaje_Avance AS "PCT_REAL", esperado AS "PCT_ESPERADO",
            CASE WHEN Porcentaje_Avance < esperado THEN CAST(Porcentaje_Avance AS DOUBLE)
                 WHEN Porcentaje_Avance IS NOT NULL THEN esperado END / 100 AS "PCT_MOSTRADO",
            CAST(Porcentaje_Avance > 0 AS INTEGER) AS "INICIADO",
            CASE WHEN Porcentaje_Avance > 0 THEN Fecha_Inicial_Real END AS "MARCA_INICIO",
            CASE WHEN Porcentaje_Avance = 100 THEN Fecha_Final_Real END AS "MARCA_FIN",
            CASE WHEN Fecha_Inicial_Real IS NOT NULL THEN CAST(Porcentaje_Avance AS VARCHAR) || '%' END AS "ETIQUETA_REAL",
            CAST(CAST(trunc(esperado) AS BIGINT) AS VARCHAR) || '%' AS "ETIQUETA_ESPERADO"FROM plan"""
    return {
        "gantt_schedule": _statement(bars, plan),
        "gantt_one_order": _statement(f"{bars} WHERE Id_Pedido = {Q.ONE_ORDER}", plan),
        "gantt_calendar": _statement(
            """SELECT Id_Pedido, Fecha_Emision + n * INTERVAL '1' DAY AS "DIA",
            CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS "MARCA_2D",
            CASE WHEN n % 2 = 0 THEN strftime(Fecha_Emision + n * INTERVAL '1' DAY, '%d') END AS "ETIQUETA_DIA",
            CASE WHEN day(Fecha_Emision + n * INTERVAL '1' DAY) = 1 THEN 1 ELSE 0 END AS "INICIO_MES",
            CASE WHEN day(Fecha_Emision + n * INTERVAL '1' DAY) = 1
                 THEN strftime(Fecha_Emision + n * INTERVAL '1' DAY, '%b') END AS "ETIQUETA_MES",
            strftime(Fecha_Emision + n * INTERVAL '1' DAY, '%d_%b') AS "ETIQUETA_EJE"
            FROM (SELECT *, unnest(range(date_diff('day', Fecha_Emision, Fecha_Entrega) + 1)) AS n FROM Pedido)"""
        ),
    }


# --- single operators ---------------------------------------------------------------------

def _operator_statements() -> dict[str, Sql]:
    share = _ratio("dCantidad", "(id % 7) * 50000")
    sales = "SELECT IdDocumento_OrdenVenta, CoddocOrdenVenta, nvDocumentoReferencia FROM docOrdenVenta"
    notes = "SELECT IdDocumento_NotaInventario, dtFechaRegistro FROM docNotaInventario"
    return {
        "scan_counts": _statement(
            " UNION ALL ".join(f"SELECT '{n}' AS \"TABLA\", COUNT(*) AS \"FILAS\" FROM {n}" for n in TABLES)
        ),
        "filter_contains": _statement(f"{sales} WHERE nvDocumentoReferencia ILIKE '%PO-1%'"),
        "filter_contains_opt": _statement(sales),
        "filter_in_list": _statement(
            "SELECT IdmaeItem_Inventario, CodmaeItemInventario, NommaeItemInventario FROM maeItemInventario "
            "WHERE NommaeItemInventario IN ('red widget', 'blue bolt')"
        ),
        "filter_day_range": _statement(
            f"{notes} WHERE CAST(dtFechaRegistro AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'"
        ),
        "filter_instant_range": _statement(
            f"{notes} WHERE dtFechaRegistro BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-31'"
        ),
        "month_bounds": _statement(
            "SELECT CAST(date_trunc('month', dtFechaPlanea) AS DATE) AS \"DESDE\", last_day(dtFechaPlanea) AS \"HASTA\", "
            'COUNT(*) AS "PEDIDOS" FROM docOrdenVenta GROUP BY ALL'
        ),
        "filter_join": _statement(
            "SELECT op.IdDocumento_OrdenProduccion, op.CoddocOrdenProduccion, op.IdtdDocumentoForm "
            "FROM docOrdenProduccion op JOIN docOrdenProduccionRuta r USING (IdDocumento_OrdenProduccion)"
        ),
        "agg_masked_sum": _statement(
            'SELECT op.IdmaeAnexo_Cliente, CAST(SUM(i.dCantidadProgramado) AS DOUBLE) AS "TOTAL", '
            'CAST(SUM(op.bCerrado * i.dCantidadRequerido) AS DOUBLE) AS "CERRADO", '
            "CAST(SUM(op.bCierreAprobado * i.dCantidadProgramado * 0.9) AS DOUBLE) AS "
            '"APROBADO" FROM docOrdenProduccion op JOIN docOrdenProduccionItem i USING (IdDocumento_OrdenProduccion) '
            "GROUP BY ALL"
        ),
        "scalar_pack": _statement(
            f"""SELECT id AS IdDocumento_OrdenVenta, {_whole('dCantidad - 50000.5')} AS "ENTERO",
            {_days('dtFechaEmision', "dtFechaPlanea + INTERVAL '36' HOUR")} AS "DIAS",
            CAST(dtFechaPlanea AS DATE) AS "DIA",
            try_cast('1996-02-' || CAST(id % 31 + 1 AS VARCHAR) AS DATE) AS "DIA_TEXTO",
            coalesce(nvDocumentoReferencia, '') AS "PO", {share} AS "RAZON",
            {_guarded('id % 3', 'id % 5', 'id % 4')} AS "RAZON_CON_GUARDA",
            {_pct(share)} AS "PORCENTAJE", {_pct(share, ' %')} AS "PORCENTAJE_ESPACIO",
            strftime(dtFechaEntrega, '%d-%b') AS "DIA_MES", strftime(dtFechaEntrega, '%d') AS "DIA_NUMERO",
            strftime(dtFechaEntrega, '%b') AS "MES", strftime(dtFechaEntrega, '%d_%b') AS "EJE",
            strftime(dtFechaEntrega, '%d-%m-%Y') AS "FECHA", left(CoddocOrdenVenta, 5) AS "IZQUIERDA",
            right(CoddocOrdenVenta, 4) AS "DERECHA", CoddocOrdenVenta || '_OP' AS "UNIDO",
            trim('  ' || CoddocOrdenVenta || ' ') AS "RECORTADO", greatest({share}, 0.5) AS "MAYOR",
            least({share}, 0.5) AS "MENOR", CASE WHEN {share} > 1 THEN 1 ELSE {share} END AS "TOPE",
            CASE WHEN {share} - 1 < 0 THEN 0 ELSE {share} - 1 END AS "PISO",
            CAST(dCantidad * 1.075 AS DOUBLE) AS "MARGEN", format('{{:,}}', {_whole('dCantidad')}) AS "MILES",
            date_trunc('second', dtFechaPlanea) AS "MOMENTO"
            FROM (SELECT *, IdDocumento_OrdenVenta AS id FROM docOrdenVenta)"""
        ),
    }


def oracle_sql(derived: bool = True) -> dict[str, str]:
    """Query name to SQL over the star schema or, if not ``derived``, over stored garment tables."""
    statements = (
        _operator_statements()
        | _order_statements()
        | _process_statements()
        | _package_statements()
        | _quality_statements()
        | _schedule_statements()
    )
    return {name: sql.text(derived) for name, sql in statements.items()}
