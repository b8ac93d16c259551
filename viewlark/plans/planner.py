"""The fluent way to a plan: each step returns a new planner, and checks names and types at once.

    from_table(trades).filter(double_gt("price", 200)).project("id", "price").order_by("price", False).build()
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import expressions as X
from ..functions.predicates import Predicate
from ..operators import Aggregate, Filter, Join, JoinKind, Measure, Operator, OrderBy, Pivot, Project, Source, WithColumn
from ..tables import BaseTable, DerivedTable, Table


class QueryPlanner:
    """``strict`` asks for STRING keys, DOUBLE sums and LONG or DOUBLE sort keys, as the types are meant."""

    def __init__(self, root: Operator, strict: bool = True):
        self.root, self.strict = root, strict

    def _then(self, root: Operator) -> QueryPlanner:
        return QueryPlanner(root, self.strict)

    @property
    def schema(self):  # noqa: ANN201
        return self.root.schema

    def filter(self, predicate: Predicate, hint: str = "") -> QueryPlanner:
        return self._then(Filter(self.root, predicate, hint, self.strict))

    def filter_expr(self, expr: X.Expr, hint: str = "") -> QueryPlanner:
        return self._then(Filter(self.root, expr, hint))

    def with_column(self, name: str, expr: X.Expr) -> QueryPlanner:
        return self._then(WithColumn(self.root, name, expr))

    def project(self, *columns: str) -> QueryPlanner:
        return self._then(Project(self.root, columns))

    def order_by(self, column: str, ascending: bool = True, nulls: str = "error") -> QueryPlanner:
        return self._then(OrderBy(self.root, column, ascending, nulls, self.strict))

    def group_by(self, key: str, *measures: Measure) -> QueryPlanner:
        return self._then(Aggregate(self.root, key, list(measures), self.strict))

    def join(self, other: Table | QueryPlanner | DataFrame, left_key: str, right_key: str, kind: JoinKind = JoinKind.INNER) -> QueryPlanner:
        right = other.root if isinstance(other, QueryPlanner) else Source(other if isinstance(other, Table) else BaseTable.of(other))
        return self._then(Join(self.root, right, left_key, right_key, kind, self.strict))

    def pivot(self, row_key: str, pivot_column: str, value: str, keys: list[str]) -> QueryPlanner:
        return self._then(Pivot(self.root, row_key, pivot_column, value, keys, self.strict))

    def build(self) -> DerivedTable:
        return DerivedTable(self.root)

    def table(self) -> Table:
        return self.build()

    def to_df(self) -> DataFrame:
        """The rows, without their order: what a query over large data wants."""
        return self.build().read().to_df()


def from_table(table: Table | DataFrame, strict: bool = True) -> QueryPlanner:
    return QueryPlanner(Source(table if isinstance(table, Table) else BaseTable.of(table)), strict)
