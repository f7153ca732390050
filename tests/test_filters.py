from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from costurero.functions import filters as P


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Acme",), ("ACME SA",), (None,)], "name string")


def test_contains_drops_nulls_even_when_empty(names):
    assert names.where(P.contains_ci("name", "acme")).count() == 2
    assert names.where(P.contains_ci("name", "")).count() == 2


def test_optional_contains_keeps_nulls_when_blank(names):
    assert names.where(P.contains_ci_opt("name", "acme")).count() == 2
    for blank in ("", "  ", None):
        assert names.where(P.contains_ci_opt("name", blank)).count() == 3


def test_contains_keeps_wildcards_and_takes_any_text_literally_otherwise(spark):
    df = spark.createDataFrame([("a1b",), ("a\\b",), ("it's",)], "name string")
    assert df.where(P.contains_ci("name", "a_b")).count() == 2
    assert df.where(P.contains_ci("name", "\\")).count() == 1
    assert df.where(P.contains_ci("name", "' OR 1=1 --")).count() == 0
    assert df.where(P.contains_ci("name", "T'S")).count() == 1


def test_list_is_trimmed_and_empty_means_all(spark):
    df = spark.createDataFrame([("P1",), ("P2",), ("P3",), (None,)], "code string")
    assert P.split_list(" P1, ,P2 ") == ["P1", "P2"]
    assert [r.code for r in df.where(P.in_list("code", " P1, ,P2 ")).collect()] == ["P1", "P2"]
    assert df.where(P.in_list("code", "")).count() == 4
    assert df.where(P.in_list("code", None)).count() == 4


def test_last_day_is_whole_for_days_and_midnight_for_instants(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 31),), (datetime(2024, 1, 31, 13),), (datetime(2024, 2, 1),), (None,)],
        "t timestamp_ntz",
    )
    assert df.where(P.day_range("t", "2024-01-01", "2024-01-31")).count() == 2
    assert df.where(P.instant_range("t", date(2024, 1, 1), "2024-01-31")).count() == 1
    assert df.where(P.after("t", "2024-01-31")).count() == 2


def test_range_must_not_end_before_it_starts():
    with pytest.raises(ValueError):
        P.day_range("t", "2024-02-01", "2024-01-31")
    with pytest.raises(ValueError):
        P.instant_range("t", "2024-02-01", "2024-01-31")


def test_thresholds_and_nulls(spark):
    df = spark.createDataFrame([(5,), (0,), (-1,), (None,)], "kg int")
    assert [r.kg for r in df.where(P.gt_or_null("kg", 0)).collect()] == [5, None]
    assert [r.kg for r in df.where(P.lt_or_null("kg", 0)).collect()] == [-1, None]
    assert [r.kg for r in df.where(P.positive("kg")).collect()] == [5]
    assert [r.kg for r in df.where(P.nonzero("kg")).collect()] == [5, -1]


def test_month_bounds(spark):
    df = spark.createDataFrame([(date(2024, 2, 10),), (date(2023, 12, 31),)], "d date")
    first, last = P.month_bounds(F.col("d"))
    assert [tuple(r) for r in df.select(first, last).collect()] == [
        (date(2024, 2, 1), date(2024, 2, 29)),
        (date(2023, 12, 1), date(2023, 12, 31)),
    ]


def test_cascade_and_domain(spark):
    df = spark.createDataFrame(
        [("A", "P1", "O1"), ("A", "P2", "O2"), ("B", "P3", "O3"), ("A", "P1", "O4")], "CLIENTE string, PEDIDO string, OP string"
    )
    assert P.cascade(df).count() == 4
    assert P.cascade(df, P.ALL).count() == 4
    assert P.cascade(df, "A").count() == 3
    assert P.cascade(df, "A", ["P1"]).count() == 2
    assert P.cascade(df, "A", ["P1"], ["O4"]).count() == 1
    assert [r[0] for r in P.domain(P.cascade(df, "A"), "PEDIDO").collect()] == ["P1", "P2"]


def test_constants_and_key(spark):
    df = spark.createDataFrame([(0, 127), (1, 127), (0, 126)], "bAnulado int, form int")
    assert P.where_equal(df, bAnulado=0, form=127).count() == 1
    assert P.where_equal(df, bAnulado=None, form=127).count() == 2
    assert P.by_key(df, "form", 126).count() == 1
    assert P.by_key(df, "form", None).count() == 3


def test_a_range_left_out_is_the_current_month():
    assert P.or_this_month(None, None, date(2024, 2, 9)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert P.or_this_month("2024-01-05", None, date(2023, 12, 31)) == ("2024-01-05", date(2023, 12, 31))


def test_domains_are_those_of_the_single_choices(spark):
    rows = [("a", "p1", "o1"), ("a", "p1", "o2"), ("a", "p2", "o3"), ("b", "p1", "o4"), (None, "p3", None), ("a", None, "o5"), ("a", "p1", "o1")]
    df = spark.createDataFrame(rows, "CLIENTE string, PEDIDO string, OP string")
    for cliente, pedidos in ((None, ()), ("a", ()), ("a", ["p1"]), (None, ["p1", "p3"]), ("none", ()), (P.ALL, ["p2"])):
        got = {}
        for r in P.domains(df, cliente, pedidos).collect():
            got.setdefault(r.NIVEL, {})[r.VALOR] = r.FILAS
        steps = {"CLIENTE": df, "PEDIDO": P.cascade(df, cliente), "OP": P.cascade(df, cliente, pedidos)}
        for name, chosen in steps.items():
            values = [r[0] for r in P.domain(chosen, name).collect()]
            assert sorted(got.get(name, {}), key=str) == sorted(values, key=str)
            assert sum(got.get(name, {}).values()) == chosen.count()
    plan = P.domains(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1
    assert P.domains(df.where("false")).collect() == []
