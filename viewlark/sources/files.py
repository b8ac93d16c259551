"""Reading and writing tables by format."""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import POS
from ..schema import Schema
from ..tables import BaseTable, Table
from . import arrow_ipc, csv, parquet


class Format(enum.Enum):
    CSV = "csv"
    ARROW = "arrow"
    PARQUET = "parquet"


def read(spark: SparkSession, fmt: Format, path: str, schema: Schema | None = None, multi_line: bool = True) -> BaseTable:
    """A sealed table.  ``schema`` says how to take a CSV file's columns; the other formats have their own.

    ``multi_line=False`` lets a large CSV file be read by many tasks, if no value of it has a line break.
    """
    if fmt is Format.CSV:
        return csv.read(spark, path, schema, multi_line)
    return (arrow_ipc if fmt is Format.ARROW else parquet).read(spark, path)


def write(table: Table, fmt: Format, path: str, single: bool = False) -> None:
    """A folder of part files in the table's order; with ``single`` one part (for small tables)."""
    {Format.CSV: csv, Format.ARROW: arrow_ipc, Format.PARQUET: parquet}[fmt].write(table, path, single)


class TableIO:
    """``reader`` and ``writer`` of a format, as callables."""

    read, write = staticmethod(read), staticmethod(write)

    @staticmethod
    def reader(fmt: Format):  # noqa: ANN205
        return lambda spark, path, schema=None, multi_line=True: read(spark, fmt, path, schema, multi_line)

    @staticmethod
    def writer(fmt: Format):  # noqa: ANN205
        return lambda table, path, single=False: write(table, fmt, path, single)


def in_order(table: Table, single: bool) -> DataFrame:
    """The table's rows, sorted over its parts; a single part is sorted in one task."""
    df = table.frame()
    return df.repartition(1).sortWithinPartitions(POS) if single else df.orderBy(POS)


def file_order() -> list:
    """What orders the rows of files: the file, and the row in it."""
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
