"""Memoised reads: by table and viewport, for as long as the table's version stays."""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .operators.core import Context, Operator
from .tables import DerivedTable, Slice, Table
from .viewport import ALL, RowRange, Viewport


class MaterializationCache(Context):
    """Reads of sources, kept as persisted frames (memory first, then disk), the least used given up first."""

    def __init__(self, slots: int = 64, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self._slots, self._level, self._lock = slots, level, threading.RLock()
        self._held: OrderedDict[tuple[int, RowRange], tuple[int, DataFrame, Table]] = OrderedDict()

    def read(self, table: Table, rows: RowRange) -> DataFrame:
        with self._lock:
            key, found = (id(table), rows), self._held.get((id(table), rows))
            if found and found[0] == table.version:
                self._held.move_to_end(key)
                return found[1]
            if found:
                found[1].unpersist()
            version, df = table.version, super().read(table, rows).persist(self._level)
            self._held[key] = (version, df, table)
            self._held.move_to_end(key)
            while len(self._held) > self._slots:
                self._held.popitem(last=False)[1][1].unpersist()
            return df

    def invalidate(self, table: Table) -> None:
        with self._lock:
            for key in [k for k in self._held if k[0] == id(table)]:
                self._held.pop(key)[1].unpersist()

    def clear(self) -> None:
        with self._lock:
            while self._held:
                self._held.popitem()[1][1].unpersist()

    def approximate_size(self) -> int:
        return len(self._held)


@dataclass(frozen=True)
class CachedDerived:
    table: DerivedTable
    cache: MaterializationCache

    @staticmethod
    def of(root: Operator) -> CachedDerived:
        cache = MaterializationCache()
        return CachedDerived(DerivedTable(root, cache), cache)

    def invalidate_all(self) -> None:
        self.cache.clear()
        self.table.invalidate()


def pull_direct(root: Operator, viewport: Viewport = ALL) -> Slice:
    return DerivedTable(root).read(viewport)


def caching_derived(root: Operator) -> CachedDerived:
    return CachedDerived.of(root)


def pull_caching(root: Operator, viewport: Viewport = ALL) -> Slice:
    """A source that the plan reads twice is read once."""
    return CachedDerived.of(root).table.read(viewport)
