"""What all operators have in common, and the leaf."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Schema
from ..shared import folder
from ..viewport import ALL_ROWS, RowRange

if TYPE_CHECKING:
    from ..tables import Table

POS = "__pos"


#: Row ranges that end beyond this many rows are cut by row number; shorter ones are a top-k in each task.
DEEP = 100_000


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, as ``name``.

    The sorted rows are written, a file for each part of the sort; a row's place
    is its row in the file behind the files before.  So no task sees more than a
    part, and the parts cannot shift between the count and the read.
    """
    path = folder(df.sparkSession)
    df.orderBy(*order).write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    before = rows.groupBy("__file").count().select("__file", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    placed = rows.join(before, "__file").withColumn(name, F.col("__before") + F.col("__row"))
    return placed.select(*backquoted(df.columns), name)


def cut(df: DataFrame, order: list, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` of ``df`` in ``order``; clamped to what there is."""
    if stop <= DEEP:
        ordered = df.orderBy(*order).limit(stop)
        return ordered.offset(start) if start else ordered
    place = F.col("__place")
    inside = (place >= start) & (place < stop)
    return numbered(df, order, "__place").filter(inside).drop("__place")


def window(df: DataFrame, rows: RowRange) -> DataFrame:
    return df if rows.is_all else cut(df, [POS], rows.start, rows.stop)


class Context:
    """How a plan reads its sources: ``read(table, rows)``.  The default reads them as they are."""

    def read(self, table: Table, rows: RowRange) -> DataFrame:
        return window(table.frame(), rows)


class Operator(ABC):
    """``schema`` is known when the plan is built; ``frame`` yields its rows with the hidden ``POS``."""

    schema: Schema

    @abstractmethod
    def inputs(self) -> list[Operator]: ...

    @abstractmethod
    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        """``rows`` is a range of the source's rows below filters and projections, and of the result's elsewhere."""

    @abstractmethod
    def signature(self) -> str:
        """The plan in one line."""

    def tables(self) -> list[Table]:
        """Its base tables, each once, through derived ones."""
        found: dict[int, Table] = {}
        for i in self.inputs():
            found.update((id(t), t) for t in i.tables())
        return list(found.values())


class Source(Operator):
    def __init__(self, table: Table):
        self.table, self.schema = table, table.schema

    def inputs(self) -> list[Operator]:
        return []

    def tables(self) -> list[Table]:
        return self.table.base_tables()

    def frame(self, ctx: Context, rows: RowRange = ALL_ROWS) -> DataFrame:
        return ctx.read(self.table, rows)

    def signature(self) -> str:
        return f"source({', '.join(self.schema.names)})"


def backquoted(names: list[str] | tuple[str, ...]) -> list:
    return [F.col(f"`{n}`") for n in names]
