"""Relational operators: nodes of a plan, each of which says what it is as a DataFrame.

Rows have an order (that of their source), carried in the hidden column ``POS``:
a number, or for derived rows whatever orders them.  It costs a sort only where
order is seen: in row ranges, limits and results that are collected.
"""

from .core import POS, Context, Operator, Source
from .joins import Join, JoinKind
from .relational import Aggregate, Filter, Measure, OrderBy, Project, WithColumn, count, sum_
from .pivots import Pivot, discover_keys

__all__ = [
    "POS", "Aggregate", "Context", "Filter", "Join", "JoinKind", "Measure", "Operator", "OrderBy", "Pivot", "Project", "Source",
    "WithColumn", "count", "discover_keys", "sum_",
]
