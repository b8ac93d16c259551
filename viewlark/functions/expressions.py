"""Expression trees over numeric columns, and what they mean in Spark.

Arithmetic is IEEE on doubles (x/0 is infinite, 0/0 is NaN); INT and LONG
columns are widened first.  Logic is two-valued: a comparison with a null or NaN
operand is false, so its negation is true, and NE is the negation of EQ.  A null
operand of arithmetic gives no value: null as a number, false in a comparison.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DataType, Schema
from .predicates import Predicate, total


class BinaryOp(enum.Enum):
    ADD, SUB, MUL, DIV = "+", "-", "*", "/"
    EQ, NE, LT, LE, GT, GE = "=", "<>", "<", "<=", ">", ">="
    AND, OR = "AND", "OR"

    @property
    def is_arithmetic(self) -> bool:
        return self.value in "+-*/"

    @property
    def is_logic(self) -> bool:
        return self in (BinaryOp.AND, BinaryOp.OR)


class UnaryOp(enum.Enum):
    NEG, NOT = "-", "NOT"


class Expr:
    """Python operators build trees: ``col("a") * 2 > col("b")``; ``&``, ``|`` and ``~`` are the logic."""

    def _with(self, op: BinaryOp, other: object, swap: bool = False) -> Binary:
        other = other if isinstance(other, Expr) else const(other)
        return Binary(op, other, self) if swap else Binary(op, self, other)

    def __add__(self, o: object) -> Binary:
        return self._with(BinaryOp.ADD, o)

    def __radd__(self, o: object) -> Binary:
        return self._with(BinaryOp.ADD, o, True)

    def __sub__(self, o: object) -> Binary:
        return self._with(BinaryOp.SUB, o)

    def __rsub__(self, o: object) -> Binary:
        return self._with(BinaryOp.SUB, o, True)

    def __mul__(self, o: object) -> Binary:
        return self._with(BinaryOp.MUL, o)

    def __rmul__(self, o: object) -> Binary:
        return self._with(BinaryOp.MUL, o, True)

    def __truediv__(self, o: object) -> Binary:
        return self._with(BinaryOp.DIV, o)

    def __rtruediv__(self, o: object) -> Binary:
        return self._with(BinaryOp.DIV, o, True)

    def __lt__(self, o: object) -> Binary:
        return self._with(BinaryOp.LT, o)

    def __le__(self, o: object) -> Binary:
        return self._with(BinaryOp.LE, o)

    def __gt__(self, o: object) -> Binary:
        return self._with(BinaryOp.GT, o)

    def __ge__(self, o: object) -> Binary:
        return self._with(BinaryOp.GE, o)

    def eq(self, o: object) -> Binary:
        return self._with(BinaryOp.EQ, o)

    def ne(self, o: object) -> Binary:
        return self._with(BinaryOp.NE, o)

    def __and__(self, o: Expr) -> Binary:
        return self._with(BinaryOp.AND, o)

    def __or__(self, o: Expr) -> Binary:
        return self._with(BinaryOp.OR, o)

    def __neg__(self) -> Unary:
        return Unary(UnaryOp.NEG, self)

    def __invert__(self) -> Unary:
        return Unary(UnaryOp.NOT, self)


@dataclass(frozen=True, eq=True)
class ColRef(Expr):
    name: str


@dataclass(frozen=True)
class Const(Expr):
    value: float | int
    type: DataType = DataType.DOUBLE


@dataclass(frozen=True)
class Unary(Expr):
    op: UnaryOp
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: BinaryOp
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    """A named function: known to ``required_columns``, refused by both evaluations."""

    name: str
    args: tuple[Expr, ...]


def col(name: str) -> ColRef:
    return ColRef(name)


def const(value: float | int) -> Const:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"no numeric constant: {value!r}")
    return Const(value, DataType.LONG if isinstance(value, int) else DataType.DOUBLE)


def required_columns(e: Expr) -> list[str]:
    """Names of the columns that ``e`` refers to, in order of first appearance."""
    if isinstance(e, ColRef):
        return [e.name]
    parts = e.args if isinstance(e, Call) else (e.arg,) if isinstance(e, Unary) else (e.left, e.right) if isinstance(e, Binary) else ()
    return list(dict.fromkeys(n for p in parts for n in required_columns(p)))


def ieee_div(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE has it, also with ANSI mode on; null in, null out."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def numeric(e: Expr, schema: Schema) -> Column:
    """The value of ``e`` as a double."""
    if isinstance(e, ColRef):
        kind = schema.field(e.name).type
        if kind not in (DataType.INT, DataType.LONG, DataType.DOUBLE):
            raise TypeError(f"{e.name} is {kind.name}: expressions take INT, LONG and DOUBLE")
        return F.col(f"`{e.name}`").cast("double")
    if isinstance(e, Const):
        if e.type not in (DataType.INT, DataType.LONG, DataType.DOUBLE):
            raise TypeError(f"constant of type {e.type.name}")
        return F.lit(float(e.value))
    if isinstance(e, Unary) and e.op is UnaryOp.NEG:
        return -numeric(e.arg, schema)
    if isinstance(e, Binary) and e.op.is_arithmetic:
        a, b = numeric(e.left, schema), numeric(e.right, schema)
        if e.op is BinaryOp.ADD:
            return a + b
        if e.op is BinaryOp.SUB:
            return a - b
        return a * b if e.op is BinaryOp.MUL else ieee_div(a, b)
    if isinstance(e, Call):
        raise NotImplementedError(f"function {e.name} cannot be evaluated")
    raise TypeError(f"not a number: {e}")


def boolean(e: Expr, schema: Schema) -> Column:
    """The truth of ``e``: never unknown."""
    if isinstance(e, Unary) and e.op is UnaryOp.NOT:
        return ~boolean(e.arg, schema)
    if isinstance(e, Binary) and e.op.is_logic:
        a, b = boolean(e.left, schema), boolean(e.right, schema)
        return a & b if e.op is BinaryOp.AND else a | b
    if isinstance(e, Binary) and not e.op.is_arithmetic:
        if e.op is BinaryOp.NE:
            return ~boolean(Binary(BinaryOp.EQ, e.left, e.right), schema)
        return total(_comparison(e, schema))
    if isinstance(e, Call):
        raise NotImplementedError(f"function {e.name} cannot be evaluated")
    raise TypeError(f"not a condition: {e}")


def _comparison(e: Binary, schema: Schema) -> Column:
    a, b = numeric(e.left, schema), numeric(e.right, schema)
    said = {BinaryOp.EQ: a == b, BinaryOp.LT: a < b, BinaryOp.LE: a <= b, BinaryOp.GT: a > b, BinaryOp.GE: a >= b}[e.op]
    for side, c in ((e.left, a), (e.right, b)):
        if _may_be_nan(side, schema):
            said = said & ~F.isnan(c)
    return said


def _may_be_nan(e: Expr, schema: Schema) -> bool:
    if isinstance(e, Const):
        return e.value != e.value
    return not (isinstance(e, ColRef) and schema.field(e.name).type in (DataType.INT, DataType.LONG))


def _for_filter(e: Expr, schema: Schema) -> Column:
    """Where unknown and false are the same, comparisons stay plain and can be pushed to the scan."""
    if isinstance(e, Binary) and e.op.is_logic:
        a, b = _for_filter(e.left, schema), _for_filter(e.right, schema)
        return a & b if e.op is BinaryOp.AND else a | b
    if isinstance(e, Binary) and not e.op.is_arithmetic and e.op is not BinaryOp.NE:
        return _comparison(e, schema)
    return boolean(e, schema)


def predicate(e: Expr) -> Predicate:
    """An expression as a predicate, bound to the schema of the table it filters."""
    return Predicate(str(e), tuple(required_columns(e)), lambda s: _for_filter(e, s))
