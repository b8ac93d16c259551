"""Named predicates.  Every one is a total boolean: a null (or NaN) fails, it is never unknown.

Where a comparison is a plain one it stays one, so that it reaches the Parquet
scan: ``is_total`` marks what the filter may use as it is, since a filter drops
unknown and false rows alike; ``column`` has the total form for NOT and NE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DataType, Schema


def total(condition: Column) -> Column:
    """Unknown becomes false."""
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class Predicate:
    """``required`` columns, the types they must have, and how to say it in Spark."""

    name: str
    required: tuple[str, ...]
    pushed: Callable[[Schema], Column]
    types: tuple[tuple[str, tuple[DataType, ...]], ...] = ()

    def check(self, schema: Schema) -> None:
        for c in self.required:
            schema.index_of(c)
        for c, allowed in self.types:
            if schema.field(c).type not in allowed:
                raise TypeError(f"{self.name}: {c} is {schema.field(c).type.name}, not {' or '.join(t.name for t in allowed)}")

    def for_filter(self, schema: Schema) -> Column:
        """May be unknown, where the filter drops the row."""
        self.check(schema)
        return self.pushed(schema)

    def column(self, schema: Schema) -> Column:
        return total(self.for_filter(schema))

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)


def _literal(value: object, what: str) -> None:
    if value is None:
        raise ValueError(f"{what}: compared with null")


def long_gt(column: str, k: int) -> Predicate:
    _literal(k, "long_gt")
    return Predicate(f"{column} > {k}", (column,), lambda s: F.col(column) > F.lit(k), ((column, (DataType.LONG,)),))


def long_eq(column: str, k: int) -> Predicate:
    _literal(k, "long_eq")
    return Predicate(f"{column} = {k}", (column,), lambda s: F.col(column) == F.lit(k), ((column, (DataType.LONG,)),))


def double_gt(column: str, k: float) -> Predicate:
    """NaN fails (Spark holds it to be the greatest value)."""
    _literal(k, "double_gt")
    say = lambda s: (F.col(column) > F.lit(float(k))) & ~F.isnan(column)
    return Predicate(f"{column} > {k}", (column,), say, ((column, (DataType.DOUBLE,)),))


def string_eq(column: str, value: str) -> Predicate:
    """Exact and case-sensitive."""
    _literal(value, "string_eq")
    return Predicate(f"{column} = {value!r}", (column,), lambda s: F.col(column) == F.lit(value), ((column, (DataType.STRING,)),))


def and_(a: Predicate, b: Predicate) -> Predicate:
    both = tuple(dict.fromkeys([*a.required, *b.required]))
    return Predicate(f"({a.name} AND {b.name})", both, lambda s: a.pushed(s) & b.pushed(s), (*a.types, *b.types))


def or_(a: Predicate, b: Predicate) -> Predicate:
    both = tuple(dict.fromkeys([*a.required, *b.required]))
    return Predicate(f"({a.name} OR {b.name})", both, lambda s: a.pushed(s) | b.pushed(s), (*a.types, *b.types))


def custom(required: list[str], make: Callable[..., Column], name: str = "custom") -> Predicate:
    """A predicate of one's own: ``make`` gets the required columns and returns a boolean ``Column``, e.g. from a pandas UDF."""
    return Predicate(name, tuple(required), lambda s: make(*(F.col(c) for c in required)))
