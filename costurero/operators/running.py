"""Running sums within groups of any size, in two levels.

A group of many rows is cut into slices of its order. A slice is summed by itself; what stands before it comes from
the sums of the earlier slices, which are few. So no task holds a whole group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costurero.operators.pivots import column

#: Groups of more rows than this are cut, into at least CUTS slices and about twice as many at most.
LARGE = 1 << 14
CUTS = 1 << 7

#: Tasks among which a large group's rows are dealt while they find their slice.
SPREAD = 32


def _matching(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they equal those of the other side, nulls included."""
    renamed = right.withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(keys)})
    return renamed, reduce(and_, [column(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)])


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other, same = _matching(right, keys)
    return left.join(other, same, "left").drop(*[f"_of_{i}" for i in range(len(keys))])


def sliced(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``_slice``: null in groups that are not cut, else the number of the group's cuts up to the row.

    The cuts are rows drawn by their hash, at a rate that follows from the number of rows, so the slices are a function
    of the data: a task that runs again finds the same. Equal rows share a slice. Only rows with a ``value`` other than
    zero are counted and drawn. Both conditions read the value, so that they stay above the aggregation ``rows`` may
    come from and all its uses share one run of it.
    """
    keys, here = [column(g) for g in group], F.struct(*[column(o) for o in order])
    hashed = F.xxhash64(*keys, *[column(o) for o in order])
    adds = column(value) != 0
    sizes = rows.where(adds).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > LARGE)
    drawn = rows.where(F.when(adds, hashed.bitwiseAND(F.lit(LARGE // CUTS - 1)) == 0)).select(
        *keys, *[column(o) for o in order]
    )
    rate = F.expr(f"shiftleft(1L, CAST(floor(log2(_rows / {CUTS})) AS INT))")
    sized, same = _matching(sizes, group)
    cuts = (
        drawn.join(sized, same)
        .where(hashed.bitwiseAND(rate - 1) == 0)
        .groupBy(*keys)
        .agg(F.collect_list(here).alias("_cuts"))
        .withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    )
    dealt = rows.withColumn("_dealt", F.pmod(hashed, F.lit(SPREAD)).cast("int"))
    # The row's place is bound once, not built anew for each cut.
    counted = F.transform(F.array(here), lambda place: F.size(F.filter("_cuts", lambda cut: cut <= place)))
    passed = F.when(F.col("_cuts").isNotNull(), counted[0])
    return _attach(dealt, cuts, [*group, "_dealt"]).withColumn("_slice", passed).drop("_dealt", "_cuts")


def running_before(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same group that come before in ``order``.

    0 for the first one. ``order`` should tell the rows of a group apart; equal ones come in no stated order. Nulls are
    a group of their own and come first in the order.
    """
    parts = sliced(rows, group, order, value)
    keys = [column(g) for g in group]

    def before(total: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(total).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    offsets = (
        parts.where(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_slice", before("_sum", W.partitionBy(*keys).orderBy("_slice")).alias("_offset"))
    )
    inside = before(value, W.partitionBy(*keys, "_slice").orderBy(*[column(o) for o in order]))
    placed = _attach(parts, offsets, [*group, "_slice"])
    return placed.withColumn(name, inside + F.coalesce(F.col("_offset"), F.lit(0))).drop("_slice", "_offset")
