"""Filter, projection, computed columns, group-by, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.predicates import Predicate
from ..schema import DataType, Field, Schema
from ..viewport import ALL_ROWS, RowRange
from .core import POS, Context, Operator, backquoted, window


class Unary(Operator):
    def __init__(self, up: Operator):
        self.up, self.schema = up, up.schema

    def inputs(self) -> list[Operator]:
        return [self.up]


class Filter(Unary):
    """Keeps rows that pass, in their order.  A row range applies to the rows before the filter."""

    def __init__(self, up: Operator, predicate: Predicate | X.Expr, hint: str = "", strict: bool = True):
        super().__init__(up)
        self.predicate = X.predicate(predicate) if isinstance(predicate, X.Expr) else predicate
        self.hint = hint
        if strict:
            self.predicate.check(self.schema)
        self.condition = self.predicate.for_filter(self.schema) if strict else self.predicate.pushed(self.schema)

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        return self.up.frame(ctx, rows).filter(self.condition)

    def signature(self) -> str:
        return f"{self.up.signature()} | filter({self.hint or self.predicate.name})"


class Project(Unary):
    def __init__(self, up: Operator, columns: list[str] | tuple[str, ...]):
        super().__init__(up)
        self.schema = up.schema.select(columns)

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        return self.up.frame(ctx, rows).select(*backquoted(self.schema.names), POS)

    def signature(self) -> str:
        return f"{self.up.signature()} | project({', '.join(self.schema.names)})"


class WithColumn(Unary):
    """Adds (or replaces) a DOUBLE column computed from an expression; null where that has no value."""

    def __init__(self, up: Operator, name: str, expr: X.Expr):
        super().__init__(up)
        self.name, self.expr = name, expr
        self.value = X.numeric(expr, up.schema)
        fields = [f for f in up.schema.fields if f.name != name]
        self.schema = Schema([*fields, Field(name, DataType.DOUBLE)])

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        kept = [n for n in self.schema.names if n != self.name]
        return self.up.frame(ctx, rows).select(*backquoted(kept), self.value.alias(self.name), POS)

    def signature(self) -> str:
        return f"{self.up.signature()} | with_column({self.name})"


@dataclass(frozen=True)
class Measure:
    kind: str  # count or sum
    output: str
    input: str | None = None


def count(output: str) -> Measure:
    """Rows of the group, also those with null values."""
    return Measure("count", output)


def sum_(column: str, output: str) -> Measure:
    """Sum of the values that are not null; 0.0 if all are."""
    return Measure("sum", output, column)


class Aggregate(Unary):
    """One row a key, in order of the keys' first rows.  Rows with a null key are in no group."""

    def __init__(self, up: Operator, key: str, measures: list[Measure], strict: bool = True):
        super().__init__(up)
        if not measures:
            raise ValueError("a group needs a measure")
        own = up.schema.field(key)
        if strict and own.type is not DataType.STRING:
            raise TypeError(f"group key {key} is {own.type.name}, not STRING")
        for m in measures:
            if m.kind == "sum" and strict and up.schema.field(m.input).type is not DataType.DOUBLE:
                raise TypeError(f"sum of {m.input}: {up.schema.field(m.input).type.name}, not DOUBLE")
        self.key, self.measures = key, measures
        self.schema = Schema([own, *(Field(m.output, DataType.LONG if m.kind == "count" else DataType.DOUBLE) for m in measures)])

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        said = {
            "count": lambda m: F.count(F.lit(1)),
            "sum": lambda m: F.coalesce(F.sum(F.col(f"`{m.input}`").cast("double")), F.lit(0.0)),
        }
        df = self.up.frame(ctx).filter(F.col(f"`{self.key}`").isNotNull())
        out = df.groupBy(f"`{self.key}`").agg(*(said[m.kind](m).alias(m.output) for m in self.measures), F.min(POS).alias(POS))
        return window(out.select(*backquoted(self.schema.names), POS), rows)

    def signature(self) -> str:
        return f"{self.up.signature()} | group({self.key}: {', '.join(m.output for m in self.measures)})"


class OrderBy(Unary):
    """A stable sort: ties keep their order either way.  NaN is the greatest value.

    ``nulls`` says what becomes of null keys: ``error`` (the default), ``first`` or ``last``.
    """

    def __init__(self, up: Operator, column: str, ascending: bool = True, nulls: str = "error", strict: bool = True):
        super().__init__(up)
        kind = up.schema.field(column).type
        if strict and kind not in (DataType.LONG, DataType.DOUBLE):
            raise TypeError(f"sort key {column} is {kind.name}, not LONG or DOUBLE")
        if nulls not in ("error", "first", "last"):
            raise ValueError(f"nulls: {nulls}")
        self.column, self.ascending, self.nulls = column, ascending, nulls

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        """The new order is the key, then the old one: a sort by ``POS`` is the sort asked for.

        So nothing is sorted here; a limit above becomes a top-k.
        """
        key = F.col(f"`{self.column}`")
        if self.nulls == "error":
            key = F.when(key.isNull(), F.raise_error(F.lit(f"null in sort key {self.column}"))).otherwise(key)
        rank = F.lit(0) if self.nulls == "error" else F.when(key.isNull(), F.lit(0 if self.nulls == "first" else 2)).otherwise(F.lit(1))
        new = F.struct(rank.alias("n"), (key if self.ascending else _descending(key, self.schema.field(self.column).type)).alias("k"), F.col(POS).alias("p"))
        df = self.up.frame(ctx)
        return window(df.select(*backquoted(self.schema.names), new.alias(POS)), rows)

    def signature(self) -> str:
        return f"{self.up.signature()} | order({self.column} {'asc' if self.ascending else 'desc'})"


def _descending(key, kind: DataType):  # noqa: ANN001, ANN202
    """A key whose ascending order is the descending order of ``key``."""
    if kind in (DataType.LONG, DataType.INT, DataType.INSTANT):
        return F.bitwise_not(key)  # never overflows
    if kind in (DataType.DOUBLE, DataType.FLOAT):
        # NaN is the greatest, and so must come first
        return F.struct((~F.isnan(key)).alias("number"), (-F.nanvl(key, F.lit(0.0))).alias("value"))
    raise TypeError(f"no descending order for {kind.name}")
