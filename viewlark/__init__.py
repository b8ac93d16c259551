"""Viewport-driven analytics on Spark."""

from .cache import CachedDerived, MaterializationCache, caching_derived, pull_caching, pull_direct
from .functions.expressions import Binary, BinaryOp, Call, ColRef, Const, Expr, Unary, UnaryOp, col, const, required_columns
from .functions.predicates import Predicate, and_, custom, double_gt, long_eq, long_gt, or_, string_eq
from .operators import JoinKind, Measure, count, discover_keys, sum_
from .plans.planner import QueryPlanner, from_table
from .schema import DataType, Field, Schema
from .sources import Format, read, write
from .tables import BaseTable, DerivedTable, Slice, Subscription, Table
from .viewport import RowRange, SortKey, Viewport

__all__ = [
    "BaseTable", "Binary", "BinaryOp", "CachedDerived", "Call", "ColRef", "Const", "DataType", "DerivedTable", "Expr", "Field", "Format",
    "JoinKind", "MaterializationCache", "Measure", "Predicate", "QueryPlanner", "RowRange", "Schema", "Slice", "SortKey", "Subscription",
    "Table", "Unary", "UnaryOp", "Viewport", "and_", "caching_derived", "col", "const", "count", "custom", "discover_keys", "double_gt",
    "from_table", "long_eq", "long_gt", "or_", "pull_caching", "pull_direct", "read", "required_columns", "string_eq", "sum_", "write",
]
