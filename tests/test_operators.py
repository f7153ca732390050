from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costurero.functions.filters import cascade
from costurero.operators.calendar import day_calendar
from costurero.operators.histogram import percent_histogram
from costurero.operators.joins import filter_join
from costurero.operators.latest import last_by_numbers
from costurero.operators.packing import MIN_REST, full_packages, split_packages
from costurero.operators.running import running_before, sliced
from costurero.operators.pivots import pivot_sums, pivot_values, unique_names
from costurero.operators.reuse import ReportCache
from costurero.plans.cut_by_client import cut_by_client
from costurero.plans.process_matrix import INDEX, presentation, process_matrix


def by_loop(quantity: int, most: int) -> list[int]:
    """Packages taken one at a time."""
    taken = []
    while quantity > 0:
        size = most if quantity > most and quantity - most >= MIN_REST else quantity
        taken.append(size)
        quantity -= size
    return taken


CASES = {(12, 5): [12], (15, 5): [5, 10], (100, 40): [40, 40, 20], (89, 40): [40, 49], (90, 40): [40, 40, 10],
         (40, 40): [40], (0, 40): []}


@pytest.mark.parametrize(("case", "expected"), CASES.items())
def test_loop_on_worked_cases(case, expected):
    assert by_loop(*case) == expected


def test_closed_form_equals_the_loop(spark):
    for most in (1, 2, 5, 9, 10, 11, 37, 60):
        rows = spark.range(1, 501).select("id", full_packages(F.col("id"), most).alias("k")).collect()
        for r in rows:
            sizes = [most] * r.k + [r.id - r.k * most]
            assert sizes == by_loop(r.id, most), (r.id, most)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 80))
def test_closed_form_in_integers(quantity, most):
    k = max(0, -(-(quantity - most - MIN_REST + 1) // most))
    assert [most] * k + [quantity - k * most] == by_loop(quantity, most)


def test_packages_number_on_and_restart_per_line(spark):
    rows = spark.createDataFrame(
        [("OS1", 2, "M", 50, 2), ("OS1", 1, "S", 100, 1), ("OS1", 3, "L", 0, 4), ("OS2", 1, "S", 7, 1)],
        "os string, n int, size string, q bigint, lines bigint",
    )
    got = split_packages(rows, "os", ["n", "size"], "q", "lines", 40).orderBy("os", "#").collect()
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in got] == [
        ("OS1", "S", 1, 40, 1, 40), ("OS1", "S", 2, 40, 41, 80), ("OS1", "S", 3, 20, 81, 100),
        ("OS1", "M", 4, 40, 1, 40), ("OS1", "M", 5, 10, 41, 50), ("OS1", "M", 6, 40, 1, 40), ("OS1", "M", 7, 10, 41, 50),
        ("OS2", "S", 1, 7, 1, 7),
    ]
    with pytest.raises(ValueError):
        split_packages(rows, "os", ["n", "size"], "q", "lines", 0)


def test_a_huge_quantity_is_spread(spark):
    rows = spark.createDataFrame([("OS", 1, "S", 50_000, 3)], "os string, n int, size string, q bigint, lines bigint")
    got = split_packages(rows, "os", ["n", "size"], "q", "lines", 1)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 3 * (50_000 - MIN_REST + 1)
    # settings as tune() leaves them: the session's partitions share the packages, none is merged away
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    check = got.agg(F.min("#"), F.max("#"), F.countDistinct("#"), F.sum("UNIDADES")).first()
    assert tuple(check) == (1, 149_973, 149_973, 150_000)


def test_filter_join_repeats_per_match(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    keys = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(tuple(r) for r in filter_join(facts, keys, "k").collect()) == [(1, "a"), (1, "a"), (2, "b")]


def histogram_of(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return {r.BIN: r for r in percent_histogram(df, {"X": "x"}).collect()}


def test_histogram_edges(spark):
    got = histogram_of(spark, [float(i) for i in range(31)])
    assert [got[i].N for i in range(30)] == [1] * 29 + [2]
    constant = histogram_of(spark, [5.0] * 4 + [None])
    assert {b: r.N for b, r in constant.items() if r.N} == {15: 4}
    assert (constant[0].DESDE, constant[29].HASTA, constant[15].PORCENTAJE) == (4.5, 5.5, 100.0)
    assert histogram_of(spark, [None, None]) == {}


@pytest.mark.parametrize("seed", range(4))
def test_histogram_equals_numpy(spark, seed):
    rnd = np.random.default_rng(seed)
    data = {"a": np.round(rnd.normal(0, 3, 4000), 2), "b": -rnd.integers(0, 9, 4000) * 0.07 * 100.0, "c": rnd.integers(1, 51, 4000) * 0.1}
    df = spark.createDataFrame(pd.DataFrame(data))
    got = {(r.METRIC, r.BIN): r for r in percent_histogram(df, {k: k for k in data}).collect()}
    for name, x in data.items():
        counts, edges = np.histogram(x, bins=30)
        assert [got[name, i].N for i in range(30)] == list(counts)
        assert [got[name, i].DESDE for i in range(30)] == list(edges[:-1])
        assert got[name, 29].HASTA == edges[-1]
        assert sum(got[name, i].PORCENTAJE for i in range(30)) == pytest.approx(100)


def summary_of(spark, rows):
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=[*INDEX, "PROCESO", "Q_REQ", "Q_PROD"]),
        ", ".join(f"{c} string" for c in [*INDEX, "PROCESO"]) + ", Q_REQ double, Q_PROD double",
    )


def test_matrix_equals_pandas(spark):
    rnd = np.random.default_rng(3)
    rows = [
        (f"P{rnd.integers(4)}", f"OP{rnd.integers(4)}", rnd.choice(["A", "B"]), f"E{rnd.integers(2)}",
         rnd.choice(["R", "N"]), rnd.choice(["CORTE", "COSTURA", "LAVADO"]), float(rnd.integers(50)), float(rnd.integers(50)))
        for _ in range(300)
    ]
    # a null key drops out
    rows += [("P9", "OP9", "A", None, "R", "CORTE", 1.0, 1.0), ("P8", "OP8", "A", "E1", "R", None, 1.0, 1.0)]
    frame = pd.DataFrame(rows, columns=[*INDEX, "PROCESO", "Q_REQ", "Q_PROD"])
    wide = frame.pivot_table(index=INDEX, columns="PROCESO", values=["Q_REQ", "Q_PROD"], aggfunc="sum", fill_value=0)
    got = process_matrix(summary_of(spark, rows))
    processes = sorted(frame.PROCESO.dropna().unique())
    assert got.columns == INDEX + [f"{p} ({m})" for p in processes for m in ("Req", "Prod")]
    mine = {tuple(r)[:5]: tuple(r)[5:] for r in got.collect()}
    theirs = {
        k: tuple(wide.loc[k][m, p] for p in processes for m in ("Q_REQ", "Q_PROD")) for k in wide.index
    }
    assert mine == theirs
    shown = presentation(process_matrix(summary_of(spark, [("P", "O", "C", "E", "R", "CORTE", 12345.0, 0.0)])))
    assert tuple(shown.first())[5:] == ("12,345", "0")
    assert cascade(got, "A").count() == sum(k[2] == "A" for k in theirs)


def test_empty_matrix_has_its_index_only(spark):
    got = process_matrix(summary_of(spark, []).where("false"))
    assert got.columns == INDEX
    assert got.count() == 0


def test_a_pivot_that_is_too_wide_is_refused(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        df = spark.range(6).select(F.col("id").cast("string").alias("c"))
        with pytest.raises(ValueError):
            pivot_values(df, "c")
        assert pivot_values(df.where("id < 5"), "c") == ["0", "1", "2", "3", "4"]
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_calendar_equals_pandas(spark):
    orders = [
        (1, datetime(2024, 1, 30, 10), datetime(2024, 3, 2, 9)),
        (2, datetime(2024, 2, 1, 10), datetime(2024, 2, 1, 10)),
        (3, datetime(2024, 2, 2), datetime(2024, 2, 1)),
    ]
    df = spark.createDataFrame(orders, "id int, a timestamp_ntz, b timestamp_ntz")
    rows = day_calendar(df, "id", "a", "b").collect()
    for key, start, end in orders:
        mine = sorted((r for r in rows if r.id == key), key=lambda r: r.DIA)
        assert [r.DIA for r in mine] == list(pd.date_range(start, end, freq="D"))
        assert [r.DIA for r in mine if r.MARCA_2D] == list(pd.date_range(start, end, freq="2D"))
        assert [r.DIA for r in mine if r.INICIO_MES] == list(pd.date_range(start, end, freq="MS"))
        assert all((r.ETIQUETA_DIA == r.DIA.strftime("%d")) if r.MARCA_2D else r.ETIQUETA_DIA is None for r in mine)
        assert all(r.ETIQUETA_MES == (r.DIA.strftime("%b") if r.INICIO_MES else None) for r in mine)


def test_report_cache_computes_once_until_refreshed(spark):
    calls = []

    def report(**params):
        calls.append(params)
        return spark.range(params["n"])

    cached = ReportCache(report)
    assert cached(n=3) is cached(n=3)
    assert cached(n=3).storageLevel.useMemory
    assert cached(n=4).count() == 4
    assert len(calls) == 2
    cached.refresh(n=3)
    cached(n=3)
    assert len(calls) == 3
    cached.clear()


def test_one_hot_order_fills_no_task(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.createDataFrame([("OS", 1, "S", 1_000_008, 1)], "os string, n int, size string, q bigint, lines bigint")
        sizes = split_packages(rows, "os", ["n", "size"], "q", "lines", 1).groupBy(F.spark_partition_id()).count().collect()
        total = sum(r["count"] for r in sizes)
        assert total == 999_999 and max(r["count"] for r in sizes) <= 0.05 * total
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_pivot_names_do_not_clash(spark):
    assert unique_names(["Acme", "ACME", "acme (2)", "X"], ["x"]) == ["Acme", "ACME (2)", "acme (2) (2)", "X (2)"]
    rows = spark.createDataFrame([("a", "Corte", 1), ("a", "CORTE", 2), ("a", "COMBO", 4)], "COMBO string, p string, q int")
    wide = pivot_sums(rows, ["COMBO"], "p", pivot_values(rows, "p"), {"q": "{}"})
    assert wide.columns == ["COMBO", "COMBO (2)", "CORTE", "Corte (2)"]
    assert [tuple(r) for r in wide.collect()] == [("a", 4, 2, 1)]


def test_clients_named_like_columns(spark):
    names = ["Acme", "ACME", "X", "X_OP", "TOTAL", "FECHA", "DIA"]
    cells = spark.createDataFrame([("1996-01-02", n, i + 1, f"OP{i}") for i, n in enumerate(names)] + [("1996-01-02", None, 50, "Z")], "d string, CLIENTE string, UNID bigint, OPS string").selectExpr("to_date(d) AS DIA", "CLIENTE", "UNID", "OPS")
    row = cut_by_client(cells).collect()[0].asDict()
    assert row["TOTAL"] == sum(range(1, 8)) and row["FECHA"] == "02-01-1996"
    assert {row[k] for k in ("ACME", "Acme (2)", "DIA", "FECHA (2)", "TOTAL (2)", "X", "X_OP")} == set(range(1, 8))
    assert row["X_OP (2)"] == "OP2"


def test_running_sums_over_groups_that_are_cut(spark):
    """One group of 200,000 rows, a null one of 20,000, small ones, all with a null in their order."""
    rows = spark.range(230_000).select(
        F.when(F.col("id") < 200_000, "hot").when(F.col("id") < 220_000, None).otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("a b"),
        F.when(F.col("id") % 1000 != 0, F.pmod(F.xxhash64("id"), F.lit(300))).alias("n"),
        F.sha2(F.col("id").cast("string"), 256).alias("t"),
        (F.col("id") % 7 + F.when(F.col("id") >= 200_000, 1).otherwise(0)).alias("v"),
    )
    got = running_before(rows, ["a b"], ["n", "t"], "v", "before").toPandas()
    want = got.sort_values(["n", "t"], na_position="first")
    sums = want.groupby("a b", dropna=False)["v"]
    assert len(got) == 230_000 and ((sums.cumsum() - want["v"]) == want["before"]).all()
    parts = sliced(rows, ["a b"], ["n", "t"], "v").groupBy("a b", "_slice").count().collect()
    hot = [r["count"] for r in parts if r["a b"] == "hot"]
    assert len(hot) > 100 and max(hot) < 0.05 * 200_000
    assert sum(r["a b"] is None for r in parts) > 100
    assert all(r["_slice"] is None for r in parts if r["a b"] and r["a b"] != "hot")


def test_one_order_of_many_sizes_fills_no_task(spark):
    """A million distinct (size, quantity) rows of one order: no slice, and no task that seeks it, holds over 5 %."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(1_000_000).select(
            F.lit("OS").alias("os"), (F.col("id") % 1000).cast("int").alias("n"),
            F.concat(F.lit("T"), F.col("id") % 1000).alias("size"),
            (F.floor(F.col("id") / 1000) + 1).alias("q"), F.lit(1).cast("bigint").alias("lines"),
        )
        slices = sliced(rows, ["os"], ["n", "size", "q"], "lines").groupBy("_slice").count().collect()
        assert max(r["count"] for r in slices) < 50_000
        got = split_packages(rows, "os", ["n", "size"], "q", "lines", 2000)
        assert tuple(got.agg(F.count("*"), F.min("#"), F.max("#"), F.countDistinct("#")).first()) == (1_000_000, 1, 1_000_000, 1_000_000)
        ordered = got.where("`#` % 1000 IN (0, 1) OR `#` = 777777").select("n", "UNIDADES", "#").collect()
        assert all(r["#"] == r["n"] * 1000 + r["UNIDADES"] for r in ordered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_last_by_numbers_is_the_greatest_tuple(spark):
    rnd = random.Random(3)
    ints, longs = [-(1 << 31), (1 << 31) - 1, -1, 0, 1, 2, 3], [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    data = [(f"k{rnd.randrange(60)}", rnd.choice([None, *ints]), rnd.choice(longs), rnd.choice(ints)) for _ in range(600)]
    data += [(None, 1, 2, 3), (None, 1, 2, 2), ("only null", None, 5, 4), ("no item", 1, None, 4)]
    rows = spark.createDataFrame(data, "`a b` string, a int, i bigint, c int")
    got = {r[0]: tuple(r)[1:] for r in last_by_numbers(rows, ["a b"], "a", "i", "c").collect()}
    want = {}
    for k, *t in data:
        if t[1] is not None:
            want[k] = max(want.get(k, t), t, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    assert got == {k: tuple(t) for k, t in want.items()}
