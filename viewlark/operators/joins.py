"""Equi-joins on one key.

Output: the left columns, then the right ones without the key.  Left rows with
a null key are dropped by LEFT and FULL, right ones by RIGHT; FULL keeps right
rows with a null key as unmatched.  The unmatched right rows of RIGHT and FULL
have null in every left column, the key included.
"""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataType, Schema
from ..viewport import ALL_ROWS, RowRange
from .core import POS, Context, Operator, backquoted, window


class JoinKind(enum.Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"


class Join(Operator):
    def __init__(self, left: Operator, right: Operator, left_key: str, right_key: str, kind: JoinKind = JoinKind.INNER, strict: bool = True):
        a, b = left.schema.field(left_key), right.schema.field(right_key)
        if strict and not a.type is b.type is DataType.STRING:
            raise TypeError(f"join keys {left_key} {a.type.name} and {right_key} {b.type.name}: both must be STRING")
        others = [f for f in right.schema.fields if f.name != right_key]
        clash = [f.name for f in others if f.name in left.schema]
        if clash:
            raise ValueError(f"columns of both sides: {clash}")
        self.left, self.right, self.left_key, self.right_key, self.kind = left, right, left_key, right_key, kind
        self.schema = Schema([*left.schema.fields, *others])

    def inputs(self) -> list[Operator]:
        return [self.left, self.right]

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        # keys are renamed, so that a table can be joined with itself
        a = self.left.frame(ctx).withColumnsRenamed({POS: "__left"})
        b = self.right.frame(ctx).withColumnsRenamed({POS: "__right", self.right_key: "__key"})
        if self.kind in (JoinKind.LEFT, JoinKind.FULL):
            a = a.filter(F.col(f"`{self.left_key}`").isNotNull())
        if self.kind is JoinKind.RIGHT:
            b = b.filter(F.col("__key").isNotNull())
        joined = a.join(b, F.col(f"`{self.left_key}`") == F.col("__key"), self.kind.value)
        # the probing side's order, then the other's; what FULL adds comes last
        if self.kind is JoinKind.RIGHT:
            pos = F.struct(F.col("__right").alias("p"), F.col("__left").alias("b"))
        else:
            pos = F.struct(F.col("__left").isNull().alias("added"), F.col("__left").alias("p"), F.col("__right").alias("b"))
        return window(joined.select(*backquoted(self.schema.names), pos.alias(POS)), rows)

    def signature(self) -> str:
        return f"{self.kind.value}({self.left.signature()}, {self.right.signature()}, {self.left_key} = {self.right_key})"
