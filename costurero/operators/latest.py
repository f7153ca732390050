"""The last row of a key by numbers, without sorting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.operators.pivots import column

_LONG = Decimal(1 << 64)
_HALF = Decimal(1 << 31)


def _place(major: Column, middle: Column, minor: Column) -> Column:
    """One number that grows as (int, long, int / 2) does: 127 bits, which a decimal of 38 digits holds.

    A null major comes before all others. The lowest bit of the minor number is left to the caller.
    """
    high = F.coalesce(major.cast("decimal(10,0)"), F.lit(Decimal(-(1 << 31) - 1)))
    mid = middle.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    low = F.shiftright(minor, 1).cast("decimal(10,0)") + F.lit(Decimal(1 << 30))
    return (high * F.lit(_LONG) + mid) * F.lit(_HALF) + low


def last_by_numbers(rows: DataFrame, keys: list[str], major: str, middle: str, minor: str) -> DataFrame:
    """``keys`` and the greatest ``(major, middle, minor)`` of each: an int, a long and an int column.

    ``major`` may be null, which is the least; rows with a null in the others do not count. All that is kept per key
    has a fixed width, so the reduction is one of hashes, first on the map side. The greatest is sought among the even
    and the odd minor numbers apart, because all three numbers together are one bit too wide for a decimal.
    """
    whole = F.col(middle).isNotNull() & F.col(minor).isNotNull()
    placed = rows.where(whole).select(
        *[column(k) for k in keys],
        *[F.col(c) for c in (major, middle, minor)],
        _place(F.col(major), F.col(middle), F.col(minor)).alias("_place"),
    )

    def of(odd: int) -> list[Column]:
        mine = F.when(F.col(minor).bitwiseAND(1) == odd, F.col("_place"))
        named = [F.max_by(c, mine).alias(f"_{i}_{odd}") for i, c in enumerate((major, middle, minor))]
        return [F.max(mine).alias(f"_place_{odd}"), *named]

    found = placed.groupBy(*[column(k) for k in keys]).agg(*of(0), *of(1))
    odd_wins = F.col("_place_0").isNull() | F.coalesce(F.col("_place_1") >= F.col("_place_0"), F.lit(False))
    chosen = [
        F.when(odd_wins, F.col(f"_{i}_1")).otherwise(F.col(f"_{i}_0")).alias(c)
        for i, c in enumerate((major, middle, minor))
    ]
    return found.select(*[column(k) for k in keys], *chosen)
