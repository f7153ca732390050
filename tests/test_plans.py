"""What the plans must look like to hold at any size."""

from __future__ import annotations

import re

import pytest

from costurero.checks.queries import EVER, queries, run, tables_of
from costurero.operators.pivots import pivot_values
from costurero.plans import cut_by_client as CC
from costurero.plans import order_progress as OP
from costurero.plans import packages as PK
from costurero.plans import process_matrix as PM
from costurero.schemas import TABLES
from costurero.sources.derived import laid_out_tables
from costurero.sources.registry import Tables
from tests.conftest import STAR_FOLDER
from tests.helpers import frames_of, random_rows


@pytest.fixture(scope="module")
def conf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("garments")
    for name, frame in frames_of(spark, random_rows(size=1200)).items():
        frame.repartition(8).write.parquet(f"{folder}/{name}")
    return {name: {"format": "parquet", "path": f"{folder}/{name}"} for name in TABLES}


@pytest.fixture(scope="module")
def large(spark, conf):
    """Tables of which none counts as small."""
    return Tables.from_conf(spark, conf)


@pytest.fixture
def settings(spark):
    kept = {}

    def use(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            kept[name] = spark.conf.get(name, None)
            spark.conf.set(name, value)

    use(autoBroadcastJoinThreshold="-1")
    yield use
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(queries()))
def test_no_pairing_of_whole_tables(large, settings, name):
    plan = plan_of(run(name, large))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    # nothing is broadcast unmeasured, except the histogram's one row per measurement
    assert ("BroadcastHashJoin" in plan) == (name == "qc_histogram")
    # a single partition only ever receives ready sums
    if "SinglePartition" in plan:
        assert name in {"orders_counts", "cut_progress_kpis", "cut_by_client_kpis", "scan_counts", "qc_histogram"} or "total" in name or "_to_" in name


def test_masters_carry_no_hint_and_plans_start_no_job(spark, large, settings):
    plan = CC.cut_orders(large, "1996-01-01", "1998-01-01")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan
    for name in TABLES:
        large[name]  # opening a file reads its schema
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in set(queries()) - {"cut_by_client", "process_matrix", "process_matrix_text", "matrix_filtered"}:
            run(name, large)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_facts_meet_the_chosen_orders_before_their_grouping(large, settings):
    plan = OP.order_progress(large, "1996-05-01", "1996-05-31", pedidos="A")._jdf.queryExecution().optimizedPlan().toString()
    # sold items, fabric orders; same-code orders, garment orders, items, notes
    assert plan.count("LeftSemi") >= 6
    summary = PM.process_summary(large)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (IdDocumento_OrdenProduccion" in summary


def test_filters_and_columns_reach_the_scans(large, settings):
    settings(maxMetadataStringLength="2000")
    plan = plan_of(OP.order_progress(large, "1996-05-01", "1996-05-31"))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    sales = next(s for s in scans if "docOrdenVenta]" in s and "PushedFilters: [Is" in s and "dtFechaPlanea" in s)
    assert "GreaterThanOrEqual(dtFechaPlanea" in sales
    assert "EqualTo(IdtdDocumentoForm,10)" in sales
    assert "LessThan(dtFechaPlanea" in sales
    notes = next(s for s in scans if "docNotaInventario]" in s)
    assert "EqualTo(IdtdDocumentoForm,131)" in notes
    assert "dtFechaRegistro" not in notes
    items = [s for s in scans if "docOrdenVentaItem]" in s]
    # required and produced kilos and the fabric orders of the chosen ones come from one kind of scan, which runs once
    assert len({s.split("ReadSchema")[1] for s in items}) == 1


def test_sums_are_combined_before_they_are_shuffled(large, settings):
    for df in (OP.garment_units(large, True), OP.fabric_kilos(large, True), PK.size_quantities(large)):
        assert "partial_sum" in plan_of(df)


def test_hot_keys_are_split_at_run_time(spark, large, settings):
    settings(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        adaptive__skewJoin__skewedPartitionFactor="1.0",
        adaptive__advisoryPartitionSizeInBytes="1KB",
        adaptive__coalescePartitions__enabled="false",
    )
    for df in (
        OP.fabric_kilos(large, True),
        OP.moved_units(large),
        CC.cut_orders(large, "1996-01-01", "1998-12-31"),
        PK.package_source(large),
    ):
        df.collect()
        assert "isSkew=true" in plan_of(df) or "skew=true" in plan_of(df), plan_of(df)[:3000]


def executed(df) -> list[str]:
    """Names of the nodes that ran: stages and reused exchanges looked through and left out."""
    df.collect()
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "ReusedExchangeExec":
            return None
        found.append(name)
        children = plan.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("variant", ["planned", "status"])
def test_key_sets_run_once(spark, variant):
    """Every table is read once for each use that is not a key set, whatever the number of facts pruned by it."""
    ran = executed(OP.order_progress(tables_of(spark, STAR_FOLDER), *EVER, variant=variant, pedidos="PED00000010, PED00000016"))
    assert ran.count("FileSourceScanExec") <= 22
    assert ran.count("ShuffleExchangeExec") <= 20


def test_key_sets_run_once_without_broadcasts(large, settings):
    ran = executed(OP.order_progress(large, "1996-01-01", "1997-12-31", variant="status"))
    # sales orders (chosen and of the same code), items sold, production orders (fabric and garment), items made for
    # either, steps (dyeing, cutting, of notes), notes, their lines, three masters of which one is read twice
    assert ran.count("FileSourceScanExec") <= 16
    assert "BroadcastHashJoinExec" not in ran


def test_total_row_reads_nothing_twice(large, settings):
    progress = OP.order_progress(large, "1996-01-01", "1997-12-31")
    with_total = OP.with_total(progress, "planned")
    scans = lambda df: plan_of(df).count("FileScan")
    assert scans(with_total) == scans(progress)
    assert executed(with_total).count("FileSourceScanExec") == executed(progress).count("FileSourceScanExec")


def test_laid_out_facts_are_pruned_and_not_shuffled_by_their_id(spark, settings):
    tables, flat = laid_out_tables(spark, STAR_FOLDER), tables_of(spark, STAR_FOLDER)
    settings(maxMetadataStringLength="4000")
    orders = CC.cut_orders(tables, "1997-03-05", "1997-05-20")
    plan = plan_of(orders)
    notes = next(line for line in plan.splitlines() if "FileScan" in line and "_mes_dtFechaRegistro" in line)
    assert "PartitionFilters: [" in notes and ">= 1997-03-01" in notes and "<= 1997-05-20" in notes
    assert plan.count("Bucketed: true") == 2
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not [line for line in moved if "IdDocumento_NotaInventario" in line or "_note" in line]
    assert "Exchange hashpartitioning(IdDocumento_NotaInventario" in plan_of(CC.cut_orders(flat, "1997-03-05", "1997-05-20"))
    for span in (("1997-03-05", "1997-05-20"), ("1996-12-31", "1997-01-01"), EVER):
        ours, theirs = CC.cut_orders(tables, *span), CC.cut_orders(flat, *span)
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty() and ours.count()
    for name in ("docNotaInventario", "docNotaInventarioItem"):
        assert tables[name].dtypes == flat[name].dtypes
        assert tables[name].exceptAll(flat[name]).isEmpty() and flat[name].exceptAll(tables[name]).isEmpty()


def test_numbering_reads_nothing_twice(large, settings):
    scans = lambda df: executed(df).count("FileSourceScanExec")
    assert scans(PK.packages(large, 40)) == scans(PK.size_quantities(large))


def test_headings_are_found_by_hash(large, settings):
    ran = executed(PK.packages_header(large))
    assert "SortAggregateExec" not in ran and ran.count("HashAggregateExec") >= 2
    assert "SortAggregate" not in plan_of(PK.packages_header(large))


def test_pages_of_a_cell_join_to_its_list(spark):
    orders = CC.cut_orders(tables_of(spark, STAR_FOLDER), *EVER)
    cells = {(r.DIA, r.CLIENTE): r.OPS for r in CC.op_lists(orders).collect()}
    pages = sorted((r.DIA, r.CLIENTE, r.PAGINA, r.OPS) for r in CC.op_list_pages(orders, 1).collect())
    joined = {}
    for day, client, page, ops in pages:
        joined.setdefault((day, client), []).append(ops)
        assert page == len(joined[day, client]) and len(ops.split(", ")) == 1
    assert {k: ", ".join(v) for k, v in joined.items()} == cells
    assert max(len(v) for v in joined.values()) > 1
    with pytest.raises(ValueError):
        CC.op_list_pages(orders, 0)


def test_pivot_names_come_from_keys(spark, large, settings, monkeypatch):
    asked = []
    monkeypatch.setattr(CC, "pivot_values", lambda df, by: asked.append(df) or [])
    monkeypatch.setattr(PM, "pivot_values", lambda df, by: asked.append(df) or [])
    CC.cut_by_client_report(large, "1996-01-01", "1997-12-31")
    PM.process_report(large, "1996-01-01", "BUILDING", ["A"])
    settings(maxMetadataStringLength="2000")
    for df in asked:
        plan = plan_of(df)
        assert "sum(" not in plan and "collect" not in plan
        read = "".join(line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line)
        assert "dCantidadRequerido" not in read and "dCantidadProgramado" not in read and "dCantidadProducido" not in read
    clients = plan_of(asked[0])
    assert "CoddocOrdenProduccion" not in clients and clients.count("LeftSemi") == 2  # the quantity only says that a line counts


def test_names_from_keys_are_those_of_the_report(large):
    for span in (("1996-01-01", "1996-06-30"), ("1995-01-01", "2002-12-31")):
        cells = CC.op_lists(CC.cut_orders(large, *span))
        assert CC.client_names(large, *span) == pivot_values(cells, "CLIENTE")
    summary = PM.process_summary(large, "1996-01-01").dropna(subset=PM.INDEX)
    assert PM.process_names(large, "1996-01-01") == pivot_values(summary, "PROCESO")
    for client in [r[0] for r in summary.select("CLIENTE").distinct().limit(3).collect()]:
        assert PM.process_names(large, "1996-01-01", client) == pivot_values(summary.where(summary["CLIENTE"] == client), "PROCESO")


def test_buckets_of_laid_out_tables_grow_with_their_lines(spark):
    flat = tables_of(spark, STAR_FOLDER)
    lines = flat["docNotaInventarioItem"].count()
    tables = laid_out_tables(spark, STAR_FOLDER, per_bucket=-(-lines // 11))
    for name in ("docNotaInventario", "docNotaInventarioItem"):
        conf = tables[name]._jdf.queryExecution().analyzed().toString().split("spark_catalog.", 1)[1]
        table = "spark_catalog." + conf.split("[", 1)[0].split(" ", 1)[0]
        found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        assert found["Num Buckets"] == "11"
    rows = [sorted(map(tuple, CC.cut_orders(t, "1995-01-01", "1996-12-31").collect()), key=str) for t in (tables, flat)]
    assert rows[0] and rows[0] == rows[1]


def test_chosen_orders_do_not_move_again_for_their_kilos(spark):
    plan = OP.order_progress(tables_of(spark, STAR_FOLDER), "1995-01-01", "2002-12-31", variant="delivery")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_id#\d+L?, \d+\), REPARTITION_BY_COL", text)
    assert not re.search(r"hashpartitioning\(_id#\d+L?, \d+\), ENSURE_REQUIREMENTS", text)


def test_small_partitions_merge_to_a_bounded_size(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def moved(df) -> list[tuple[str, list[str]]]:
    """How each shuffle that ran deals its rows, and the columns it moves."""
    df.collect()
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "ReusedExchangeExec":
            return None
        if name == "ShuffleExchangeExec":
            output = plan.output()
            found.append((plan.outputPartitioning().toString(), [output.apply(i).name() for i in range(output.length())]))
        for i in range(plan.children().length()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("variant", ["delivery", "status"])
def test_items_made_move_once_for_kilos_and_units(large, settings, variant):
    shuffles = moved(OP.order_progress(large, "1996-01-01", "1997-12-31", variant=variant))
    assert len([by for by, columns in shuffles if "dCantidadProgramado" in columns]) == 1


@pytest.mark.parametrize("variant", ["delivery", "status"])
def test_units_come_to_the_orders(large, settings, variant):
    shuffles = moved(OP.order_progress(large, "1996-01-01", "1997-12-31", variant=variant))
    texts = [by for by, columns in shuffles if "PO" in columns]
    assert len(texts) == 1 and re.match(r"hashpartitioning\(_id#", texts[0])


def test_kilos_are_dealt_by_fabric_order(large, settings):
    shuffles = moved(OP.order_progress(large, "1996-01-01", "1997-12-31", variant="status"))
    for column in ("_fabric", "_asked_of"):
        dealt = [by for by, columns in shuffles if column in columns and len(columns) > 1]
        assert len(dealt) == 1 and re.match(rf"hashpartitioning\({column}#\d+L?, \d+\)", dealt[0])


def test_rows_with_a_total_move_their_texts_once_before_it(large, settings):
    with_total = OP.with_total(OP.order_progress(large, "1996-01-01", "1997-12-31", variant="status"), "status")
    assert len([by for by, columns in moved(with_total) if "PO" in columns]) == 1


def test_derived_notes_group_their_lines_once(spark, settings):
    shuffles = moved(OP.moved_units(tables_of(spark, STAR_FOLDER)))
    assert len([by for by, columns in shuffles if "l_linenumber" in columns]) == 1
