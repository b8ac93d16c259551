"""Pivot: sums of a value by row key and by the values of a second column, one column for each of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataType, Field, Schema
from ..viewport import ALL_ROWS, RowRange
from .core import POS, Context, Operator, backquoted, window


class Pivot(Operator):
    """Rows whose key is unlisted, or that have a null in any of the three columns, are skipped; missing cells are 0.0."""

    def __init__(self, up: Operator, row_key: str, pivot_column: str, value: str, keys: list[str], strict: bool = True):
        for name, kind in ((row_key, DataType.STRING), (pivot_column, DataType.STRING), (value, DataType.DOUBLE)):
            if strict and up.schema.field(name).type is not kind:
                raise TypeError(f"pivot: {name} is {up.schema.field(name).type.name}, not {kind.name}")
        if len(set(keys)) < len(keys):
            raise ValueError(f"pivot keys repeat: {keys}")
        self.up, self.row_key, self.pivot_column, self.value, self.keys = up, row_key, pivot_column, value, list(keys)
        self.schema = Schema([up.schema.field(row_key), *(Field(k, DataType.DOUBLE) for k in keys)])

    def inputs(self) -> list[Operator]:
        return [self.up]

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        r, p, v = (F.col(f"`{n}`") for n in (self.row_key, self.pivot_column, self.value))
        df = self.up.frame(ctx).filter(r.isNotNull() & v.isNotNull() & p.isin(self.keys))
        # one aggregate with a condition for each key: a single partial and final hash aggregate
        cells = [F.coalesce(F.sum(F.when(p == F.lit(k), v.cast("double"))), F.lit(0.0)).alias(k) for k in self.keys]
        out = df.groupBy(r.alias(self.row_key)).agg(*cells, F.min(POS).alias(POS))
        return window(out.select(*backquoted(self.schema.names), POS), rows)

    def signature(self) -> str:
        return f"{self.up.signature()} | pivot({self.row_key}, {self.pivot_column}, {self.value})"


def discover_keys(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Distinct values of ``column`` that are not null, in order of first appearance; they become columns: over ``most`` are an error."""
    firsts = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("key")).agg(F.min(POS).alias(POS))
    keys = [r["key"] for r in firsts.orderBy(POS).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"over {most} different values of {column}")
    return keys
