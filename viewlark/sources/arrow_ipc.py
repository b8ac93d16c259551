"""Arrow IPC files, as a Spark data source in Python: ``spark.read.format("arrow_ipc").load(path)``.

A record batch is a partition; a task writes a file of its own, under a name of
its own, so that a task that is run again does no harm.  Timestamps of any unit
are nanoseconds (LONG, marked INSTANT), fixed-size lists are arrays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.core import POS
from ..schema import DataType, Field, Schema
from ..tables import BaseTable, Table

NAME = "arrow_ipc"
_TYPES = [
    (pa.types.is_int32, DataType.INT), (pa.types.is_int64, DataType.LONG), (pa.types.is_float32, DataType.FLOAT),
    (pa.types.is_float64, DataType.DOUBLE), (pa.types.is_boolean, DataType.BOOLEAN), (pa.types.is_string, DataType.STRING),
    (pa.types.is_large_string, DataType.STRING), (pa.types.is_timestamp, DataType.INSTANT), (pa.types.is_int16, DataType.INT), (pa.types.is_int8, DataType.INT),
]
_ARROW = {
    DataType.INT: pa.int32(), DataType.LONG: pa.int64(), DataType.FLOAT: pa.float32(), DataType.DOUBLE: pa.float64(),
    DataType.BOOLEAN: pa.bool_(), DataType.STRING: pa.string(), DataType.INSTANT: pa.timestamp("ns", "UTC"),
    DataType.DOUBLE_ARRAY: pa.float64(), DataType.INT_ARRAY: pa.int32(), DataType.STRING_ARRAY: pa.string(), DataType.DATE_ARRAY: pa.timestamp("ns", "UTC"),
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, own = _store(path)
    info = store.get_file_info(own)
    if info.type is fs.FileType.File:
        return [own]
    found = store.get_file_info(fs.FileSelector(own))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".arrow"))


def field_of(f: pa.Field) -> Field:
    if pa.types.is_fixed_size_list(f.type):
        v = f.type.value_type
        kind = DataType.DOUBLE_ARRAY if pa.types.is_floating(v) else DataType.INT_ARRAY if pa.types.is_int32(v) else DataType.STRING_ARRAY
        return Field(f.name, DataType.DATE_ARRAY if pa.types.is_timestamp(v) or pa.types.is_int64(v) else kind, f.type.list_size)
    for says, kind in _TYPES:
        if says(f.type):
            return Field(f.name, kind)
    raise ValueError(f"{f.name}: no column type for Arrow's {f.type}")


def arrow_schema(schema: Schema) -> pa.Schema:
    one = lambda f: pa.list_(_ARROW[f.type], f.array_length) if f.array_length else _ARROW[f.type]
    return pa.schema([pa.field(f.name, one(f)) for f in schema.fields])


def _plain(array: pa.Array, f: Field) -> pa.Array:
    """As Spark takes it."""
    if f.type is DataType.INSTANT:
        return array.cast(pa.timestamp("ns", array.type.tz)).cast(pa.int64())
    if f.array_length:
        value = {DataType.DOUBLE_ARRAY: pa.float64(), DataType.INT_ARRAY: pa.int32(), DataType.STRING_ARRAY: pa.string(), DataType.DATE_ARRAY: pa.int64()}[f.type]
        if f.type is DataType.DATE_ARRAY and pa.types.is_timestamp(array.type.value_type):
            return pa.array([None if r is None else [x.value if hasattr(x, "value") else None for x in r] for r in (s.values if s.is_valid else None for s in array)], pa.list_(pa.int64()))
        return array.cast(pa.list_(value))
    return array.cast(_ARROW[f.type])


@dataclass
class _Batch(InputPartition):
    path: str
    batch: int
    at: int

    def __init__(self, path: str, batch: int, at: int):
        self.path, self.batch, self.at = path, batch, at


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Batch]:
        store, _ = _store(self.path)
        out = []

        def batches(f: str) -> int:
            with store.open_input_file(f) as opened, pa.ipc.open_file(opened) as file:
                return file.num_record_batches

        files = _files(self.path)
        with ThreadPoolExecutor(32) as pool:  # footers alone, many at a time
            for k, (f, n) in enumerate(zip(files, pool.map(batches, files))):
                out += [_Batch(f, b, k) for b in range(n)]
        return out or [_Batch("", -1, 0)]

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        if partition.batch < 0:
            return
        store, _ = _store(self.path)
        names = [f.name for f in self.schema if f.name != POS]
        with store.open_input_file(partition.path) as opened, pa.ipc.open_file(opened) as whole:
            wanted = [whole.schema.get_field_index(n) for n in names]
        options = pa.ipc.IpcReadOptions(included_fields=wanted)  # what is not asked for is not read
        with store.open_input_file(partition.path) as opened, pa.ipc.open_file(opened, options=options) as file:
            b = file.get_batch(partition.batch).select(names)
            arrays = [_plain(b.column(i), field_of(b.schema.field(i))) for i in range(b.num_columns)]
            place = [pa.array([k] * b.num_rows, pa.int64()) for k in (partition.at, partition.batch)]  # files and batches in order
            pos = pa.StructArray.from_arrays([*place, pa.array(range(b.num_rows), pa.int64())], ["file", "batch", "row"])
            yield pa.RecordBatch.from_arrays([*arrays, pos], [*b.schema.names, POS])


@dataclass
class _Written(WriterCommitMessage):
    path: str


class ArrowIpcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: Schema):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        name = f"{own}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tmp"
        target = arrow_schema(self.schema)
        with store.open_output_stream(name) as sink, pa.ipc.new_file(sink, target) as out:
            for b in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([_typed(b.column(f.name), f, target.field(f.name).type) for f in self.schema.fields], schema=target))
        return _Written(name)

    def commit(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.move(m.path, m.path.removesuffix(".tmp") + ".arrow")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


def _typed(array: pa.Array, f: Field, kind: pa.DataType) -> pa.Array:
    if f.array_length:
        rows = array.to_pylist()
        return pa.array(rows, pa.list_(pa.int64(), f.array_length)).view(kind) if f.type is DataType.DATE_ARRAY and None not in rows else pa.array(rows, kind)
    return array.cast(pa.int64()).cast(kind) if f.type is DataType.INSTANT else array.cast(kind)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        path = self.options["path"]
        store, _ = _store(path)
        files = _files(path)
        if not files:
            raise FileNotFoundError(f"no Arrow file in {path}")
        with store.open_input_file(files[0]) as opened, pa.ipc.open_file(opened) as file:
            own = Schema([field_of(f) for f in file.schema]).to_spark()
        wanted = json.loads(self.options.get("columns", "null"))
        place = T.StructType([T.StructField(n, T.LongType()) for n in ("file", "batch", "row")])
        return T.StructType([*(f for f in own if wanted is None or f.name in wanted), T.StructField(POS, place)])

    def reader(self, schema: T.StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowIpcWriter:
        fields = [Field(n, DataType[k], length) for n, k, length in json.loads(self.options["fields"])]
        return ArrowIpcWriter(self.options["path"], Schema(fields))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArrowIpcSource)
    return spark


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> BaseTable:
    """A sealed table of all columns, or of some: then no others are read."""
    store, _ = _store(path)
    files = _files(path)
    if not files:
        raise FileNotFoundError(f"no Arrow file in {path}")
    with store.open_input_file(files[0]) as opened, pa.ipc.open_file(opened) as file:
        own = Schema([field_of(f) for f in file.schema])
    if columns is not None:
        own = Schema([f for f in own.select(columns).fields])
    df = _registered(spark).read.format(NAME).option("columns", json.dumps(columns)).load(path)
    marked = [F.col(f"`{f.name}`").alias(f.name, metadata=f.to_spark().metadata) for f in own.fields]
    return BaseTable.of(df.select(*marked, POS), own)


def write(table: Table, path: str, single: bool = False) -> None:
    from .files import in_order

    rows = in_order(table, single).drop(POS)
    fields = json.dumps([(f.name, f.type.name, f.array_length) for f in table.schema.fields])
    _registered(rows.sparkSession)
    rows.write.format(NAME).mode("append").option("fields", fields).save(path)
