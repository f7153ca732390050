"""Connected components of an edge table, by stars that shrink towards the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
    tied = both.where("u > v").join(least, "v")
    return tied.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    tied = edges.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return tied.unionAll(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and is not itself its component's smallest node.

    `edges` has two bigint columns `v` and `u`; direction, repeats and self-loops do not matter, nulls are
    dropped. Each round writes its edges to the shared folder; the number of rounds grows with the logarithm of
    the longest path. Minima are aggregated before they meet the edges of a hot node, whose join may be split.
    """
    pairs = edges.where("v IS NOT NULL AND u IS NOT NULL AND v <> u")
    now = stored(pairs.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
