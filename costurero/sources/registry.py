"""Where the input tables come from.

A table is named in a configuration and read by Spark's own readers:

``{"format": "parquet", "path": "..."}``
    files of any built-in format;
``{"table": "catalog.schema.table"}``
    a catalog table, three-part names included; of one laid out by month (``sinks.lay_out``) a range of instants reads
    only its months, and buckets serve the joins by their id;
``{"format": "jdbc", "options": {...}}``
    a database table, read in parallel slices;
``{"frame": df}``
    a DataFrame the caller already has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costurero.functions.filters import check_range
from costurero.schemas import TABLES, conform
from costurero.sources.sinks import PART

_SLICES = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def load(spark: SparkSession, name: str, conf: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Read the table ``name`` as configured, with its contract columns and types."""
    return conform(_read(spark, name, conf), name)


def _pruned(df: DataFrame, column: str, start: date | str, end: date | str) -> DataFrame:
    """``df`` without the months outside the range, if it is laid out by the instant ``column``."""
    first, last = check_range(start, end)
    if PART + column not in df.columns:
        return df
    return df.where(F.col(PART + column).between(F.trunc(F.lit(first), "MM"), F.lit(last)))


def _read(spark: SparkSession, name: str, conf: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    spec = conf[name]
    if "frame" in spec:
        return spec["frame"]
    if "table" in spec:
        return spark.table(spec["table"])
    options = dict(spec.get("options", {}))
    if spec["format"] == "jdbc":
        # An unsliced database read would pull a whole table through one task.
        missing = [o for o in _SLICES if o not in options]
        if missing:
            raise ValueError(f"{name}: a jdbc table needs {', '.join(missing)}")
    reader = spark.read.format(spec["format"]).options(**options)
    if spec["format"] in ("csv", "json"):
        reader = reader.schema(TABLES[name])
    return reader.load(spec["path"]) if "path" in spec else reader.load()


class Tables:
    """The input tables of the reports, resolved by name, lazily and once.

    ``resolve`` gives a table, which may have more columns than ``finish`` leaves of it: those it is laid out by.
    """

    def __init__(
        self, resolve: Callable[[str], DataFrame], finish: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
    ):
        self._resolve = resolve
        self._finish = finish
        self._whole: dict[str, DataFrame] = {}
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_conf(cls, spark: SparkSession, conf: Mapping[str, Mapping[str, Any]]) -> Tables:
        return cls(lambda name: _read(spark, name, conf), conform)

    def _resolved(self, name: str) -> DataFrame:
        if name not in self._whole:
            self._whole[name] = self._resolve(name)
        return self._whole[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._finish(self._resolved(name), name)
        return self._frames[name]

    def laid_out(self, name: str, column: str) -> bool:
        """Whether the table is laid out by the months of ``column``."""
        return PART + column in self._resolved(name).columns

    def within(self, name: str, column: str, start: date | str, end: date | str) -> DataFrame:
        """The table, without those of its partitions that hold no row of these days of ``column``.

        The range itself is still the caller's to state.
        """
        return self._finish(_pruned(self._resolved(name), column, start, end), name)
