"""Aggregates over flags, totals and text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costurero.operators.pivots import column

#: Sums of quantities. Leaves room for a factor and a difference without losing a digit.
QTY = "decimal(28,4)"


def masked_sum(flag: Column, value: Column) -> Column:
    """Sum of ``flag * value`` for a 0/1 flag, without the cost of a decimal product.

    Rows with a null flag do not count; a group without other rows sums to null.
    """
    return F.sum(F.when(flag == 1, value).when(flag == 0, F.lit(0).cast(QTY)))


def sorted_list(name: str, separator: str = ", ") -> Column:
    """The collected values of a column as one text, ascending."""
    return F.array_join(F.sort_array(F.collect_list(name)), separator)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def totals(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row with the sum of every numeric column; nulls are skipped."""
    wanted = set(columns) if columns is not None else None
    names = [c for c in numeric_columns(df) if wanted is None or c in wanted]
    return df.agg(*[F.sum(F.col(c)).alias(c) for c in names])


def totals_table(df: DataFrame, columns: list[str], label: str = "Total") -> DataFrame:
    """One row for the chosen columns: sums where numeric, ``label`` elsewhere."""
    numeric = set(numeric_columns(df))
    return totals(df, columns).select(
        *[F.col(c) if c in numeric else F.lit(label).alias(c) for c in columns]
    )


def append_total(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The chosen columns plus a grand-total row, told apart by ``is_total``.

    Each row goes on as itself, under a number of its own, and as a share of the total; the shares are summed before they
    are shuffled. So the body is computed once, whatever it is, and equal rows stay apart. Without rows the total is null.
    """
    body = df.select(*columns) if columns is not None else df
    numeric = set(numeric_columns(body))
    held = [F.struct(*[column(c) for c in body.columns], F.lit(t).alias("is_total")) for t in (0, 1)]
    numbered = body.select(F.monotonically_increasing_id().alias("_row"), F.explode(F.array(*held)).alias("_of"))
    # The total's own row, so that it is there without any other.
    seed = body.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("_row"), F.lit(None).cast(numbered.schema["_of"].dataType).alias("_of")
    )
    own = F.coalesce(F.col("_of.is_total"), F.lit(1)) == 0
    field = {c: F.col("_of")[c] for c in body.columns}
    rows = numbered.unionByName(seed).groupBy(
        F.when(own, 0).otherwise(1).alias("is_total"),
        F.when(own, F.col("_row")).alias("_row"),
        *[F.when(own, field[c]).alias(c) for c in body.columns if c not in numeric],
    )
    return rows.agg(*[F.sum(field[c]).alias(c) for c in body.columns if c in numeric]).select(
        *[column(c) for c in body.columns], "is_total"
    )

