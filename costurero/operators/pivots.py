"""Values of a column as columns of the result."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_values(df: DataFrame, by: str) -> list[str]:
    """The distinct non-null values of a pivot column, in order.

    Only column names travel to the driver, and no more of them than the session
    allows a pivot to have; a pivot that would be wider is refused, never cut.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.where(F.col(by).isNotNull()).select(by).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{by} has more than {limit} values; raise spark.sql.pivotMaxValues")
    return sorted(r[0] for r in rows)


def column(name: str) -> Column:
    """A column by its exact name, whatever signs a pivot value brought into it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique_names(wanted: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Column names told apart as Spark does, without regard to case.

    A name that equals an earlier or a ``taken`` one gets `` (2)``, `` (3)``, ... behind it.
    """
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        n, new = 1, name
        while new.lower() in used:
            n += 1
            new = f"{name} ({n})"
        used.add(new.lower())
        out.append(new)
    return out


def cell(by: str, value: str, measure: Column) -> Column:
    """``measure`` on the rows of one pivot value, null elsewhere."""
    return F.when(F.col(by) == F.lit(value), measure)


def pivot_sums(
    df: DataFrame, index: list[str], by: str, values: list[str], measures: Mapping[str, str]
) -> DataFrame:
    """Sum of several measures per pivot value, interleaved, absent cells 0, rows with a null key dropped.

    ``measures`` maps a measure to its label pattern, e.g. ``{"Q_REQ": "{} (Req)"}``.
    One grouping with conditional sums, so the rows are combined before their only shuffle.
    Cells are named by place and renamed at the end, so values that differ only in case, or
    equal another column's name, do not clash.
    """
    for name in [*index, by]:
        df = df.where(F.col(name).isNotNull())
    pairs = [(v, m, pattern) for v in values for m, pattern in measures.items()]
    if not pairs:
        return df.select(*index).distinct()
    cells = [F.coalesce(F.sum(cell(by, v, F.col(m))), F.lit(0)).alias(f"_c{i}") for i, (v, m, _) in enumerate(pairs)]
    names = unique_names((pattern.format(v) for v, _, pattern in pairs), index)
    return df.groupBy(*index).agg(*cells).toDF(*index, *names)
