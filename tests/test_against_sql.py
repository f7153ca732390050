"""Every query against its SQL: on the star schema, and on random tables with hot keys."""

from __future__ import annotations

import duckdb
import pytest

from costurero.checks.compare import connect, differences, rows_of_duckdb, rows_of_spark
from costurero.checks.oracle import oracle_sql
from costurero.checks.queries import queries, run
from tests.conftest import STAR_FOLDER
from tests.helpers import frames_of, random_rows
from costurero.sources.registry import Tables


@pytest.fixture(scope="module")
def star():
    return connect(STAR_FOLDER)


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_on_the_star_schema(spark, star, name):
    assert differences(spark, STAR_FOLDER, name, star) == []


@pytest.fixture(scope="module")
def garments(spark):
    """Random tables, on both engines; no table is small enough to broadcast."""
    frames = frames_of(spark, random_rows())
    connection = duckdb.connect()
    for name, frame in frames.items():
        stored = frame.toArrow()  # noqa: F841 - read by name below
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM stored")
    conf = {n: {"frame": f} for n, f in frames.items()}
    return Tables.from_conf(spark, conf), connection


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: Queries whose parameters name values of the star schema only.
STAR_ONLY = {
    "filter_in_list", "filter_day_range", "filter_instant_range", "orders_progress_list", "orders_searched", "packages_one_os",
    "qc_report_searched",
}


@pytest.mark.parametrize("name", [n for n in queries() if n not in STAR_ONLY])
def test_on_random_tables_with_hot_keys(garments, no_broadcast, name):
    tables, connection = garments
    names, mine = rows_of_spark(run(name, tables))
    theirs_names, theirs = rows_of_duckdb(connection, oracle_sql(derived=False)[name])
    assert names == theirs_names
    assert mine
    assert mine == theirs


def odd_rows():
    """Random tables in which keys and quantities are missing."""
    rows = random_rows(seed=11, size=300)
    for name, columns in {
        "docOrdenVenta": ["CoddocOrdenVenta", "IdDocumento_OrdenVenta"],
        "docOrdenVentaItem": ["IdDocumento_OrdenVenta", "IdDocumento_Referencia", "IdmaeItem", "dCantidad"],
        "docOrdenProduccion": ["IdDocumento_OrdenProduccion", "IdDocumento_Referencia"],
        "docOrdenProduccionItem": ["IdDocumento_OrdenProduccion", "IdmaeItem", "dCantidadProgramado", "dCantidadRequerido"],
        "docNotaInventarioItem": ["IdDocumento_NotaInventario", "IdmaeItem_Inventario", "dCantidadIng"],
    }.items():
        for k, column in enumerate(columns):
            for row in rows[name][k :: 17]:
                row[column] = None
    return rows


@pytest.mark.parametrize(
    "name", ["orders_progress_delivery", "orders_status_pct", "orders_status_with_total", "orders_counts", "orders_totals"]
)
def test_orders_on_rows_with_missing_keys_and_quantities(spark, no_broadcast, name):
    frames = frames_of(spark, odd_rows())
    connection = duckdb.connect()
    for table, frame in frames.items():
        stored = frame.toArrow()  # noqa: F841 - read by name below
        connection.execute(f"CREATE TABLE {table} AS SELECT * FROM stored")
    _, mine = rows_of_spark(run(name, Tables.from_conf(spark, {n: {"frame": f} for n, f in frames.items()})))
    _, theirs = rows_of_duckdb(connection, oracle_sql(derived=False)[name])
    assert mine
    assert mine == theirs
