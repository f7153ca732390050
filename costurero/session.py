"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning: small partitions merge, a side that proves small is broadcast, and a
# partition that one hot key fills is split, also where that costs a further shuffle. Small
# partitions merge up to 8 MB and no further: a task of a report holds the sorts and groupings of
# several joins at once, in memory 30 to 90 times the shuffled bytes of its partition. Two sides of
# which one already lies by some of the keys meet there, so that only the other moves.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; partition counts stay the cluster's own."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
