"""Parquet, with arrays as arrays and instants as nanoseconds.

Types without a counterpart keep their values: a timestamp in nanoseconds is
read as INSTANT, other units stay Spark timestamps.  Files in which an array is
a Base64 string (big-endian values, the length in the column's name: ``x__DARR3``
and so for IARR, SARR, TARR) are decoded by ``read_encoded``.
"""

from __future__ import annotations

import base64
import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.core import POS
from ..schema import DataType, Field, Schema
from ..tables import BaseTable, Table

_SUFFIX = re.compile(r"^(.*)__([DIST])ARR(\d+)$")
_KINDS = {"D": DataType.DOUBLE_ARRAY, "I": DataType.INT_ARRAY, "S": DataType.STRING_ARRAY, "T": DataType.DATE_ARRAY}


def _load(spark: SparkSession, path: str) -> DataFrame:
    key = "spark.sql.legacy.parquet.nanosAsLong"  # Spark refuses TIMESTAMP(NANOS) otherwise
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df = spark.read.parquet(path)
        return df.select(*df.columns, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(POS))
    finally:
        spark.conf.set(key, before)


def read(spark: SparkSession, path: str) -> BaseTable:
    """The order is that of the files' names, and of the rows in each."""
    return BaseTable.of(_load(spark, path))


def write(table: Table, path: str, single: bool = False) -> None:
    from .files import in_order

    fields = [F.col(f"`{f.name}`").alias(f.name, metadata=f.to_spark().metadata) for f in table.schema.fields]
    in_order(table, single).select(*fields).write.parquet(path)


def decode(text: str | None, kind: str, n: int) -> list | None:
    if text is None:
        return None
    raw = base64.b64decode(text)
    if kind == "S":  # each string: its length (-1: null) and its bytes
        out, at = [], 0
        for _ in range(n):
            (size,) = struct.unpack_from(">i", raw, at)
            at += 4
            out.append(None if size < 0 else raw[at : at + size].decode())
            at += max(0, size)
        return out
    return list(struct.unpack(f">{n}{ {'D': 'd', 'I': 'i', 'T': 'q'}[kind] }", raw))


def _decoder(field: Field, kind: str):  # noqa: ANN202
    @F.pandas_udf(field.to_spark().dataType)
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: decode(v, kind, field.array_length))

    return decoded


def read_encoded(spark: SparkSession, path: str) -> BaseTable:
    """As ``read``, with Base64 array columns decoded and named without the suffix."""
    df = _load(spark, path)
    columns, fields = [], []
    for f in Schema.from_spark(T.StructType([f for f in df.schema if f.name != POS])).fields:
        m = _SUFFIX.match(f.name)
        if not m:
            columns.append(F.col(f"`{f.name}`"))
            fields.append(f)
            continue
        own = Field(m[1], _KINDS[m[2]], int(m[3]))
        columns.append(_decoder(own, m[2])(F.col(f"`{f.name}`")).alias(own.name, metadata=own.to_spark().metadata))
        fields.append(own)
    return BaseTable.of(df.select(*columns, POS), Schema(fields))
