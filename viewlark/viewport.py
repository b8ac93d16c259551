"""What part of a table a consumer looks at: a row range, a column subset, an order, a limit."""

from __future__ import annotations

from dataclasses import dataclass

UNBOUNDED = (1 << 63) - 1


@dataclass(frozen=True)
class RowRange:
    """Half open: ``start <= row < stop``."""

    start: int = 0
    stop: int = UNBOUNDED

    def __post_init__(self) -> None:
        if self.start < 0 or self.stop < self.start:
            raise ValueError(f"no row range: [{self.start}, {self.stop})")

    @staticmethod
    def of(start: int, stop: int) -> RowRange:
        return RowRange(start, stop)

    @staticmethod
    def head(n: int) -> RowRange:
        return RowRange(0, n)

    @property
    def is_all(self) -> bool:
        return self.start == 0 and self.stop == UNBOUNDED

    def __len__(self) -> int:
        return self.stop - self.start

    @property
    def size(self) -> int:
        return self.stop - self.start

    def intersect(self, other: RowRange) -> RowRange:
        start = max(self.start, other.start)
        return RowRange(start, max(start, min(self.stop, other.stop)))

    def hull(self, other: RowRange) -> RowRange:
        return RowRange(min(self.start, other.start), max(self.stop, other.stop))


ALL_ROWS = RowRange()


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True

    @staticmethod
    def asc(column: str) -> SortKey:
        return SortKey(column, True)

    @staticmethod
    def desc(column: str) -> SortKey:
        return SortKey(column, False)


@dataclass(frozen=True)
class Viewport:
    """Compared by value, so that it can be a key.  ``rows`` of a filtered table are rows of its source."""

    rows: RowRange = ALL_ROWS
    columns: tuple[str, ...] | None = None
    order: tuple[SortKey, ...] | None = None
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit < 0:
            raise ValueError(f"limit: {self.limit}")

    @staticmethod
    def all() -> Viewport:
        return ALL

    @staticmethod
    def of_rows(start: int, stop: int) -> Viewport:
        return Viewport(rows=RowRange(start, stop))

    @staticmethod
    def of_columns(*names: str) -> Viewport:
        return Viewport(columns=names)

    @staticmethod
    def builder() -> ViewportBuilder:
        return ViewportBuilder()

    @property
    def has_limit(self) -> bool:
        return self.limit is not None

    def union(self, other: Viewport) -> Viewport:
        """The hull of the ranges and all columns of both; order and limit are dropped."""
        both = None
        if self.columns is not None and other.columns is not None:
            both = tuple(dict.fromkeys([*self.columns, *other.columns]))
        return Viewport(rows=self.rows.hull(other.rows), columns=both)


ALL = Viewport()


class ViewportBuilder:
    def __init__(self) -> None:
        self._parts: dict = {}

    def rows(self, start: int | RowRange, stop: int | None = None) -> ViewportBuilder:
        self._parts["rows"] = start if isinstance(start, RowRange) else RowRange(start, stop)
        return self

    def columns(self, *names: str) -> ViewportBuilder:
        self._parts["columns"] = tuple(names)
        return self

    def order(self, *keys: SortKey) -> ViewportBuilder:
        self._parts["order"] = tuple(keys)
        return self

    def limit(self, n: int) -> ViewportBuilder:
        self._parts["limit"] = n
        return self

    def build(self) -> Viewport:
        return Viewport(**self._parts)
