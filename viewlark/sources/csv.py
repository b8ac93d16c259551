"""CSV with a header.

Read: an empty field is null.  Without a schema each column is the first of INT,
LONG, DOUBLE and STRING that takes all its values (a column of nulls is INT); a
column of ``true`` or of instants is STRING.  With a schema columns are found by
their names; those the file lacks are null, and others are passed over; a value
that its type does not take is an error.

Write: fields with a comma, a quote or a line break are quoted; null is empty;
arrays cannot be written.

``multi_line`` files can have line breaks in quotes, but each is read by one
task; turn it off for large files without such fields.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants
from ..operators.core import POS
from ..schema import DataType, Field, Schema
from ..tables import BaseTable, Table

_WHOLE = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?)$"


def _strings(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line, "nullValue": "", "emptyValue": ""}
    df = spark.read.options(**options).csv(path)
    # files are read whole and in order: within one the order is that of its rows
    pos = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    names = [c for c in df.columns if c != POS]
    return df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names), pos.alias(POS))


def _real(c: Column) -> Column:
    return F.when(c.rlike(_REAL), F.regexp_replace(c, "[dDfF]$", "").try_cast("double"))


def infer(df: DataFrame) -> Schema:
    """One pass over all rows."""
    names = [c for c in df.columns if c != POS]

    def fits(c: str) -> list[Column]:
        v = F.col(f"`{c}`")
        whole = lambda t: v.isNull() | (v.rlike(_WHOLE) & v.try_cast(t).isNotNull())
        all_of = lambda x: F.coalesce(F.bool_and(x), F.lit(True))
        return [all_of(whole("int")), all_of(whole("bigint")), all_of(v.isNull() | _real(v).isNotNull())]

    said = df.agg(*(x.alias(f"{i}_{k}") for i, c in enumerate(names) for k, x in enumerate(fits(c)))).first()
    ladder = (DataType.INT, DataType.LONG, DataType.DOUBLE)
    return Schema([Field(c, next((t for k, t in enumerate(ladder) if said[f"{i}_{k}"]), DataType.STRING)) for i, c in enumerate(names)])


def _parsed(f: Field, present: bool) -> Column:
    kind = f.to_spark().dataType
    if not present:
        return F.lit(None).cast(kind)
    v = F.col(f"`{f.name}`")
    bad = F.raise_error(F.concat(F.lit(f"{f.name}: no {f.type.name}: "), v))
    if f.type is DataType.STRING:
        return v
    if f.type is DataType.INSTANT:
        return instants.from_text(v)
    if f.type is DataType.BOOLEAN:  # whatever is not true is false
        return F.lower(v) == F.lit("true")
    good = _real(v).cast(kind) if f.type in (DataType.DOUBLE, DataType.FLOAT) else F.when(v.rlike(_WHOLE), v.try_cast(kind))
    return F.when(v.isNull() | good.isNotNull(), good).otherwise(bad.cast(kind))


def read(spark: SparkSession, path: str, schema: Schema | None = None, multi_line: bool = True) -> BaseTable:
    df = _strings(spark, path, multi_line)
    own = schema or infer(df)
    if any(f.type.is_array for f in own.fields):
        raise ValueError("CSV has no arrays")
    fields = [_parsed(f, f.name in df.columns).alias(f.name, metadata=f.to_spark().metadata) for f in own.fields]
    return BaseTable.of(df.select(*fields, POS), own)


def write(table: Table, path: str, single: bool = False) -> None:
    from .files import in_order

    if any(f.type.is_array for f in table.schema.fields):
        raise ValueError("CSV has no arrays")
    said = [instants.to_text(F.col(f"`{f.name}`")).alias(f.name) if f.type is DataType.INSTANT else F.col(f"`{f.name}`") for f in table.schema.fields]
    rows = in_order(table, single).select(*said)
    rows.write.options(header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)


