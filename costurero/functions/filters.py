"""Row predicates of the reports.

Parameters always enter a plan as literals, never as SQL text. A ``%`` or ``_``
typed by a user keeps its meaning as a wildcard.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterable
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "Todos"  # fixed value: the client choice that means "no filter"


def as_day(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def check_range(start: date | str, end: date | str) -> tuple[date, date]:
    """Both ends as dates; refuses a range that ends before it starts."""
    first, last = as_day(start), as_day(end)
    if first > last:
        raise ValueError(f"the range starts on {first}, after its end {last}")
    return first, last


def or_this_month(
    start: date | str | None, end: date | str | None, today: date | None = None
) -> tuple[date | str, date | str]:
    """The range as given; an end left out is that of the current month."""
    today = today or date.today()
    last = calendar.monthrange(today.year, today.month)[1]
    return start or today.replace(day=1), end or today.replace(day=last)


def where_equal(df: DataFrame, **values: Any) -> DataFrame:
    """Keep rows whose columns equal the given constants; ``None`` leaves a column free."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def nonzero(column: str) -> Column:
    return F.col(column) != 0


def positive(column: str) -> Column:
    return F.col(column) > 0


def contains_ci(column: str, text: str) -> Column:
    """Case-insensitive contains. Always applied: even an empty text drops nulls."""
    escaped = text.replace("\\", "\\\\")
    return F.col(column).ilike(f"%{escaped}%")


def contains_ci_opt(column: str, text: str | None) -> Column:
    """Case-insensitive contains that keeps every row, nulls too, when the text is blank."""
    if not text or not text.strip():
        return F.lit(True)
    return contains_ci(column, text.strip())


def split_list(text: str | Iterable[str] | None) -> list[str]:
    """``"a, ,b "`` as ``["a", "b"]``."""
    if text is None:
        return []
    parts = text.split(",") if isinstance(text, str) else text
    return [p.strip() for p in parts if p.strip()]


def in_list(column: str, text: str | Iterable[str] | None) -> Column:
    """Membership in a comma-separated list; every row when the list is empty."""
    values = split_list(text)
    return F.col(column).isin(values) if values else F.lit(True)


def day_range(column: str, start: date | str, end: date | str) -> Column:
    """Closed range of days: the last day counts to its end. Pushed to the scan as a half-open range."""
    first, last = check_range(start, end)
    return F.to_date(F.col(column)).between(F.lit(first), F.lit(last))


def instant_range(column: str, start: date | str, end: date | str) -> Column:
    """Closed range of instants: of the last day only midnight counts."""
    first, last = check_range(start, end)
    return F.col(column).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))


def after(column: str, day: date | str) -> Column:
    """Strictly later than the midnight that starts ``day``."""
    return F.col(column) > F.lit(as_day(day)).cast("timestamp_ntz")


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First and last day of the month of ``day``: the default range of the reports."""
    return F.trunc(day, "MM"), F.last_day(day)


def gt_or_null(column: str, bound: float) -> Column:
    return (F.col(column) > F.lit(bound)) | F.col(column).isNull()


def lt_or_null(column: str, bound: float) -> Column:
    return (F.col(column) < F.lit(bound)) | F.col(column).isNull()


def cascade(
    df: DataFrame, cliente: str | None = None, pedidos: Iterable[str] = (), ops: Iterable[str] = ()
) -> DataFrame:
    """Client, then its orders, then their production orders; an empty choice filters nothing."""
    if cliente and cliente != ALL:
        df = df.where(F.col("CLIENTE") == F.lit(cliente))
    if pedidos:
        df = df.where(F.col("PEDIDO").isin(list(pedidos)))
    if ops:
        df = df.where(F.col("OP").isin(list(ops)))
    return df


def domain(df: DataFrame, column: str) -> DataFrame:
    """The values of a column under the filters so far, in order."""
    return df.select(column).distinct().orderBy(column)


def domains(df: DataFrame, cliente: str | None = None, pedidos: Iterable[str] = ()) -> DataFrame:
    """What each choice of a cascade offers, with its rows: ``NIVEL, VALOR, FILAS`` from one pass.

    Clients come from all rows, orders from those of the chosen client, production orders from those of the chosen
    orders too, as ``domain`` of ``cascade`` would give them one by one. Each row counts under three grouping sets,
    which are summed before they are shuffled.
    """
    chosen = F.lit(True) if not cliente or cliente == ALL else F.coalesce(F.col("CLIENTE") == F.lit(cliente), F.lit(False))
    wanted = list(pedidos)
    ordered = chosen & (F.coalesce(F.col("PEDIDO").isin(wanted), F.lit(False)) if wanted else F.lit(True))
    rows = df.select("CLIENTE", "PEDIDO", "OP", F.lit(True).alias("_c"), chosen.alias("_p"), ordered.alias("_o"))
    levels = (("CLIENTE", "_c"), ("PEDIDO", "_p"), ("OP", "_o"))
    keys = [c for level in levels for c in level]
    counted = rows.groupingSets([list(level) for level in levels], *keys).agg(
        F.count("*").alias("FILAS"), *[F.grouping(name).alias(f"_not_{name}") for name, _ in levels]
    )
    at = lambda name: F.col(f"_not_{name}") == 0
    level = value = offered = None
    for name, flag in levels:
        level = F.when(at(name), name) if level is None else level.when(at(name), name)
        value = F.when(at(name), F.col(name)) if value is None else value.when(at(name), F.col(name))
        offered = at(name) & F.col(flag) if offered is None else offered | (at(name) & F.col(flag))
    return counted.where(offered).select(level.alias("NIVEL"), value.alias("VALOR"), "FILAS")


def by_key(df: DataFrame, column: str, value: Any | None) -> DataFrame:
    """One document, or every document when no value is given."""
    return df if value is None else df.where(F.col(column) == F.lit(value))
