"""Results that are used more than once."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class ReportCache:
    """Keeps the result of a report per set of parameters until it is refreshed."""

    def __init__(self, report: Callable[..., DataFrame]):
        self._report = report
        self._kept: dict[Hashable, DataFrame] = {}

    @staticmethod
    def _key(params: dict[str, Any]) -> Hashable:
        return tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in params.items()))

    def __call__(self, **params: Any) -> DataFrame:
        key = self._key(params)
        if key not in self._kept:
            self._kept[key] = self._report(**params).persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[key]

    def refresh(self, **params: Any) -> None:
        """Drop the kept result of these parameters, so that the next call computes it again."""
        kept = self._kept.pop(self._key(params), None)
        if kept is not None:
            kept.unpersist()

    def clear(self) -> None:
        for kept in self._kept.values():
            kept.unpersist()
        self._kept.clear()
