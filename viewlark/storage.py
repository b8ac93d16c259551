"""Which frames are held in memory: a budget, the least used moved out first, pins against that.

HOT is memory, WARM is off the heap or on disk; Spark moves the blocks, this says which.
"""

from __future__ import annotations

import enum
import itertools
import threading
from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Residency(enum.Enum):
    HOT = "hot"
    WARM = "warm"


_LEVELS = {Residency.HOT: StorageLevel.MEMORY_AND_DISK, Residency.WARM: StorageLevel.DISK_ONLY}


class Pin:
    """While it is open its frame stays HOT."""

    def __init__(self, manager: ResidencyManager, key: int, df: DataFrame):
        self._manager, self._key, self.df, self._open = manager, key, df, True

    def close(self) -> None:
        if self._open:
            self._open = False
            self._manager._unpin(self._key)

    def __enter__(self) -> Pin:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class _Entry:
    def __init__(self, df: DataFrame, size: int):
        self.df, self.size, self.residency, self.pins = df, size, Residency.HOT, 0


class ResidencyManager:
    def __init__(self, max_hot_bytes: int):
        if max_hot_bytes < 0:
            raise ValueError(f"budget: {max_hot_bytes}")
        self.max_hot_bytes = max_hot_bytes
        self._entries: OrderedDict[int, _Entry] = OrderedDict()
        self._ids, self._lock = itertools.count(), threading.RLock()

    @property
    def hot_bytes(self) -> int:
        return sum(e.size for e in self._entries.values() if e.residency is Residency.HOT)

    def admit(self, df: DataFrame, size: int | None = None) -> int:
        """Hold ``df``; its size is the optimizer's estimate unless given."""
        own = size if size is not None else int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        with self._lock:
            key = next(self._ids)
            self._entries[key] = _Entry(df.persist(_LEVELS[Residency.HOT]), own)
            self._fit()
            return key

    def current(self, key: int) -> DataFrame:
        return self._entry(key).df

    def residency(self, key: int) -> Residency:
        return self._entry(key).residency

    def touch(self, key: int) -> None:
        with self._lock:
            self._move(self._entry(key), Residency.HOT)
            self._entries.move_to_end(key)
            self._fit()

    def pin(self, key: int) -> Pin:
        with self._lock:
            e = self._entry(key)
            e.pins += 1  # first, so that making room does not move it out again
            self.touch(key)
            return Pin(self, key, e.df)

    def _unpin(self, key: int) -> None:
        with self._lock:
            if key in self._entries:
                self._entries[key].pins -= 1
                self._fit()

    def remove(self, key: int) -> None:
        with self._lock:
            self._entry(key).df.unpersist()
            del self._entries[key]

    def close(self) -> None:
        with self._lock:
            for key in list(self._entries):
                self.remove(key)

    def _entry(self, key: int) -> _Entry:
        if key not in self._entries:
            raise KeyError(f"nothing is held under {key}")
        return self._entries[key]

    def _move(self, e: _Entry, to: Residency) -> None:
        if e.residency is not to:
            e.df.unpersist()
            e.df.persist(_LEVELS[to])
            e.residency = to

    def _fit(self) -> None:
        for e in list(self._entries.values()):
            if self.hot_bytes <= self.max_hot_bytes:
                return
            if e.residency is Residency.HOT and not e.pins:
                self._move(e, Residency.WARM)
