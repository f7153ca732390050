from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costurero.functions import scalars as S
from costurero.operators.aggregates import append_total, masked_sum, totals, totals_table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(("value", "expected"), [("2.7", 2), ("-2.7", -2), (None, None), ("99999999999.9", 99999999999)])
def test_whole_truncates(spark, value, expected):
    assert one(spark, S.whole(lit(value, "decimal(18,4)"))) == expected


@pytest.mark.parametrize(("hours", "days"), [(36, 2), (35, 1), (-36, -2), (0, 0)])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_are_rounded_in_any_zone(spark, hours, days, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        start = lit("2024-03-10 01:00:00", "timestamp_ntz")  # a clock change lies ahead in one of the zones
        end = start + F.expr(f"INTERVAL {hours} HOUR") if hours >= 0 else start - F.expr(f"INTERVAL {-hours} HOUR")
        assert one(spark, S.days_between(start, end)) == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ratios(spark):
    assert one(spark, S.ratio(lit(10), lit(0))) is None
    assert one(spark, S.ratio(lit(None), lit(5))) is None
    assert one(spark, S.guarded_ratio(lit(0), lit(3), lit(4))) == 0
    assert one(spark, S.guarded_ratio(lit(5), lit(2), lit(0))) is None
    assert one(spark, S.guarded_ratio(lit(5), lit(2), lit(8))) == 0.25
    assert one(spark, S.guarded_ratio(lit(None), lit(2), lit(8))) == 0
    assert one(spark, S.guarded_ratio(lit(1), lit(174), lit(640))) == 0.27188


@pytest.mark.parametrize(("share", "label"), [(0.455, "46%"), (0.285, "29%"), (-0.004, "0%"), (1.2, "120%"), (None, None)])
def test_percent_label(spark, share, label):
    assert one(spark, S.percent_label(lit(share))) == label


def test_texts(spark):
    moment = lit("2024-08-05 10:00:00", "timestamp_ntz")
    assert one(spark, S.percent_text(lit(0.45))) == "45 %"
    assert one(spark, S.day_month(moment)) == "05-Aug"
    assert one(spark, S.day_text(moment)) == "05-08-2024"
    assert one(spark, S.first_chars(F.lit("ABCDEFGHIJKLMNOPQ"))) == "ABCDEFGHIJKLMNO"
    assert one(spark, S.last_chars(F.lit("abc"), 2)) == "bc"
    assert one(spark, S.thousands(lit(1234.5))) == "1,234"
    assert one(spark, S.day_of_text(F.lit("2024-02-31"))) is None
    assert one(spark, S.day_of_text(F.lit("2024-02-29"))) == date(2024, 2, 29)
    assert one(spark, S.day_of(lit(datetime(2024, 8, 5, 10), "timestamp_ntz"))) == date(2024, 8, 5)


def test_bounds_keep_nulls(spark):
    assert one(spark, S.cap_at_one(lit(1.5))) == 1
    assert one(spark, S.cap_at_one(lit(None))) is None
    assert one(spark, S.floor_at_zero(lit(-2))) == 0
    assert one(spark, S.floor_at_zero(lit(None))) is None


def test_masked_sum(spark):
    df = spark.createDataFrame(
        [("a", 1, Decimal(2)), ("a", 0, Decimal(3)), ("b", None, Decimal(4)), ("c", 0, Decimal(5))],
        "k string, flag int, v decimal(18,4)",
    )
    got = dict(df.groupBy("k").agg(masked_sum(F.col("flag"), F.col("v"))).collect())
    assert got == {"a": 2, "b": None, "c": 0}


def test_totals_skip_nulls_and_are_told_apart(spark):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", None, 1.5), ("c", 4, None)], "code string, n int, x double")
    assert tuple(totals(df).first()) == (5, 4.0)
    assert tuple(totals_table(df, ["n", "code"]).first()) == (5, "Total")
    rows = append_total(df, ["code", "n"]).collect()
    assert [tuple(r) for r in rows if r.is_total] == [(None, 5, 1)]
    assert len(rows) == 4
    nothing = append_total(df.where("false")).collect()
    assert [tuple(r) for r in nothing] == [(None, None, None, 1)]
