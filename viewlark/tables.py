"""Tables: sealed, live and derived; slices: what a read returns.

A table has a version.  A read is of one version: a slice is a ``DataFrame``
over immutable batches, and stays what it was whatever is appended later.
"""

from __future__ import annotations

import math
import threading
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretty
from .operators.core import POS, Context, Operator, backquoted, cut
from .schema import DataType, Field, Schema
from .shared import folder
from .viewport import ALL, RowRange, Viewport

Listener = Callable[[int], None]


class Slice:
    """Rows of a table as seen through a viewport: ``schema``, ``version`` and a lazy, ordered ``DataFrame``."""

    def __init__(self, df: DataFrame, schema: Schema, version: int, ordered: DataFrame | None = None):
        self._df, self._ordered, self.schema, self.version = df, df if ordered is None else ordered, schema, version
        self._rows: list | None = None
        self._count: int | None = None

    @staticmethod
    def empty(spark: SparkSession, schema: Schema, version: int) -> Slice:
        return Slice(spark.createDataFrame([], schema.to_spark()), schema, version)

    def to_df(self) -> DataFrame:
        """The rows, in no particular order: nothing is sorted for it."""
        return self._df

    def ordered(self) -> DataFrame:
        return self._ordered

    def to_arrow(self):  # noqa: ANN201
        return self._ordered.toArrow()

    def collect(self) -> list:
        """All rows, in order, on the driver; kept."""
        if self._rows is None:
            self._rows = self._ordered.collect()
        return self._rows

    def head(self, n: int) -> list:
        return self._rows[:n] if self._rows is not None else self._ordered.limit(n).collect()

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.collect()]

    def column(self, key: int | str) -> list:
        name = self.schema.field(key).name
        return [r[name] for r in self.collect()]

    @property
    def row_count(self) -> int:
        if self._count is None:
            self._count = len(self._rows) if self._rows is not None else self._df.count()
        return self._count

    @property
    def column_count(self) -> int:
        return len(self.schema)

    def to_pretty_string(self, max_rows: int = 20, max_cols: int = 10, max_cell_width: int = 40) -> str:
        return pretty.format_slice(self, max_rows, max_cols, max_cell_width)

    def pretty_print(self, max_rows: int = 20) -> None:
        print(self.to_pretty_string(max_rows), end="")

    def __repr__(self) -> str:
        return f"Slice({self.schema}, version={self.version})"


class Subscription:
    """A consumer's hold on a table: ``update_viewport`` delivers anew, ``close`` ends it (again and again, if you like)."""

    def __init__(self, table: Table, viewport: Viewport, on_change: Callable[[Slice], None], detach: Callable[[], None]):
        self._table, self._on_change, self._detach = table, on_change, detach
        self.viewport, self.is_active = viewport, True

    def deliver(self) -> None:
        if self.is_active:
            self._on_change(self._table.read(self.viewport))

    def update_viewport(self, viewport: Viewport) -> None:
        if self.is_active:
            self.viewport = viewport
            self.deliver()

    def close(self) -> None:
        if self.is_active:
            self.is_active = False
            self._detach()

    def __enter__(self) -> Subscription:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Table(ABC):
    schema: Schema

    @property
    @abstractmethod
    def version(self) -> int: ...

    @property
    @abstractmethod
    def size(self) -> int: ...

    @abstractmethod
    def read(self, viewport: Viewport = ALL) -> Slice: ...

    @abstractmethod
    def frame(self) -> DataFrame:
        """The current version's rows, with the hidden order."""

    @abstractmethod
    def base_tables(self) -> list[Table]: ...

    @abstractmethod
    def subscribe(self, viewport: Viewport, on_change: Callable[[Slice], None]) -> Subscription: ...

    def to_pretty_string(self, max_rows: int = 20, max_cols: int = 10, max_cell_width: int = 40) -> str:
        return self.read().to_pretty_string(max_rows, max_cols, max_cell_width)

    def pretty_print(self, max_rows: int = 20) -> None:
        self.read().pretty_print(max_rows)

    def show(self, viewport: Viewport = ALL, **options: Any):  # noqa: ANN201
        """Open the browser viewer on this table (see ``viewer``); returns the running server."""
        from .viewer import serve

        return serve(self, viewport, **options)


def finish(df: DataFrame, schema: Schema, viewport: Viewport, version: int) -> Slice:
    """What is above the plan: order, column subset, limit."""
    order = [F.col(f"`{k.column}`").asc() if k.ascending else F.col(f"`{k.column}`").desc() for k in viewport.order or ()]
    for k in viewport.order or ():
        schema.index_of(k.column)
    shown = schema.select(viewport.columns) if viewport.columns is not None else schema
    names = backquoted(shown.names)
    if viewport.has_limit:
        first = cut(df, [*order, POS], 0, viewport.limit)
        return Slice(first.select(*names), shown, version, first.orderBy(*order, POS).select(*names))
    ordered = df.orderBy(*order, POS)
    return Slice(df.select(*names), shown, version, ordered.select(*names))


class BaseTable(Table):
    """A source table.

    ``create`` makes a live table, which takes rows until it is sealed; every
    append is a new version.  Appended rows are kept as immutable batches, and a
    read of a version is a frame over the batches up to it.  ``of`` wraps a
    frame, whatever its size, as a sealed table.
    """

    #: Appended rows are gathered up to this number before they become a frame of their own.
    BATCH_ROWS = 10_000
    _POS = T.StructField(POS, T.StructType([T.StructField("batch", T.LongType()), T.StructField("row", T.LongType())]), False)

    def __init__(self, spark: SparkSession, schema: Schema):
        self.spark, self.schema = spark, schema
        self._struct = schema.to_spark()
        self._lock = threading.RLock()
        self._batches: list[DataFrame | str] = []  # frames, and places of what was written
        self._rows: list[tuple] = []
        self._uncounted: list[DataFrame] = []
        self._size, self._version, self._sealed = 0, 0, False
        self._listeners: list[Listener] = []
        self._frame: tuple[int, DataFrame] | None = None
        self._given: DataFrame | None = None
        self._plain: DataFrame | None = None

    @staticmethod
    def create(spark: SparkSession, schema: Schema) -> BaseTable:
        return BaseTable(spark, schema)

    @staticmethod
    def builder(spark: SparkSession, schema: Schema) -> TableBuilder:
        return TableBuilder(spark, schema)

    @staticmethod
    def of(df: DataFrame, schema: Schema | None = None, order: list[str] | None = None) -> BaseTable:
        """A sealed table over ``df``.

        Its order is that of the columns ``order``, or of ``df``'s own hidden
        order, or (only safe for small frames) of its partitions.
        """
        shown = schema or Schema.from_spark(T.StructType([f for f in df.schema if f.name != POS]))
        plain = df.select(*backquoted(shown.names))
        if POS not in df.columns:
            pos = F.struct(*order) if order else F.monotonically_increasing_id()
            df = df.withColumn(POS, pos)
        t = BaseTable(df.sparkSession, shown)
        t._given = df.select(*backquoted(shown.names), POS)
        t._plain, t._sealed = plain, True
        return t

    def unordered(self) -> DataFrame:
        """The rows without any order of theirs."""
        return self._plain if self._plain is not None else self.frame().drop(POS)

    @property
    def version(self) -> int:
        return self._version

    @property
    def size(self) -> int:
        if self._given is not None:
            return self._given.count()
        with self._lock:
            while self._uncounted:  # frames are counted when somebody asks
                self._size += self._uncounted.pop().count()
            return self._size

    @property
    def is_sealed(self) -> bool:
        return self._sealed

    def base_tables(self) -> list[Table]:
        return [self]

    def seal(self) -> None:
        self._sealed = True

    def append_row(self, *values: Any) -> None:
        if len(values) != len(self.schema):
            raise ValueError(f"{len(values)} values for {len(self.schema)} columns")
        self._append([values])

    def append_rows(self, rows: Iterable[tuple]) -> None:
        """Many rows at once: one version, one notification."""
        rows = list(rows)
        for r in rows:
            if len(r) != len(self.schema):
                raise ValueError(f"{len(r)} values for {len(self.schema)} columns")
        self._append(rows)

    def row(self) -> RowAppender:
        return RowAppender(self.schema, lambda values: self._append([values]))

    def _append(self, rows: list[tuple]) -> None:
        taken = [tuple(accept(f, v) for f, v in zip(self.schema.fields, r)) for r in rows]
        with self._lock:
            if self._sealed:
                raise RuntimeError("the table is sealed")
            at, first = len(self._batches), len(self._rows)
            self._rows += [(*r, (at, first + i)) for i, r in enumerate(taken)]
            self._size += len(taken)
            if len(self._rows) >= self.BATCH_ROWS:
                self._flush()
        self._changed()

    def append_frame(self, df: DataFrame) -> None:
        """Rows of ``df``, however many, as one batch and one version: they stay where they are."""
        for f in self.schema.fields:
            if df.schema[f.name].dataType != f.to_spark().dataType:
                raise TypeError(f"{f.name}: {df.schema[f.name].dataType.simpleString()}, not {f.type.name}")
        with self._lock:
            if self._sealed:
                raise RuntimeError("the table is sealed")
            if self._rows:
                self._flush()
            pos = F.struct(F.lit(len(self._batches)).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))
            fields = [F.col(f"`{f.name}`").alias(f.name, metadata=f.to_spark().metadata) for f in self.schema.fields]
            own = df.select(*fields, pos.alias(POS))
            self._batches.append(own)
            self._uncounted.append(own)
        self._changed()

    def _changed(self) -> None:
        with self._lock:
            self._version += 1
            version, listeners = self._version, list(self._listeners)
        for listener in listeners:  # on the thread that appends, outside the lock
            listener(version)

    def _flush(self) -> None:
        """Write the gathered rows to shared storage: the driver holds no more than ``BATCH_ROWS`` of them."""
        path = folder(self.spark)
        self.spark.createDataFrame(self._rows, T.StructType([*self._struct, self._POS])).write.parquet(path)
        self._batches.append(path)
        self._rows = []

    def _stored(self, paths: list[str]) -> DataFrame:
        own = T.StructType([*self._struct, self._POS])
        df = self.spark.read.schema(own).parquet(*paths)
        return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in own))

    def frame(self) -> DataFrame:
        if self._given is not None:
            return self._given
        with self._lock:
            if self._frame is None or self._frame[0] != self._version:
                # batches on storage that follow one another are one scan
                runs = groupby(self._batches, key=lambda b: isinstance(b, str))
                parts = [df for stored, run in runs for df in ([self._stored(list(run))] if stored else run)]
                if self._rows or not parts:
                    parts.append(self.spark.createDataFrame(self._rows, T.StructType([*self._struct, self._POS])))
                df = parts[0]
                for b in parts[1:]:
                    df = df.unionByName(b)
                self._frame = (self._version, df)
            return self._frame[1]

    def add_listener(self, listener: Listener) -> None:
        with self._lock:
            self._listeners.append(listener)

    def remove_listener(self, listener: Listener) -> None:
        with self._lock:
            self._listeners = [x for x in self._listeners if x is not listener]

    def read(self, viewport: Viewport = ALL) -> Slice:
        with self._lock:
            df, version = self.frame(), self._version
        return finish(Context().read(_Fixed(df), viewport.rows), self.schema, viewport, version)

    def subscribe(self, viewport: Viewport, on_change: Callable[[Slice], None]) -> Subscription:
        """One delivery now, and one after each append."""
        listener: Listener = lambda _: held.deliver()
        held = Subscription(self, viewport, on_change, lambda: self.remove_listener(listener))
        if not self._sealed:
            self.add_listener(listener)
        held.deliver()
        return held


class _Fixed:
    """A frame in place of a table."""

    def __init__(self, df: DataFrame):
        self._df = df

    def frame(self) -> DataFrame:
        return self._df


class TableBuilder:
    """Rows for a sealed table of version 0."""

    def __init__(self, spark: SparkSession, schema: Schema):
        self._table = BaseTable(spark, schema)

    def append_row(self, *values: Any) -> TableBuilder:
        self._table.append_row(*values)
        return self

    def append_rows(self, rows: Iterable[tuple]) -> TableBuilder:
        self._table.append_rows(rows)
        return self

    def row(self) -> RowAppender:
        return self._table.row()

    def build(self) -> BaseTable:
        self._table._version = 0
        self._table._frame = None
        self._table.seal()
        return self._table


class RowAppender:
    """Sets single values; columns that are not set become null.  Nothing is locked before ``commit``."""

    def __init__(self, schema: Schema, take: Callable[[tuple], None]):
        self._schema, self._take, self._values, self._done = schema, take, {}, False

    def set(self, column: int | str, value: Any) -> RowAppender:
        at = column if isinstance(column, int) else self._schema.index_of(column)
        if not 0 <= at < len(self._schema):
            raise IndexError(f"column {column}")
        if at in self._values:
            raise ValueError(f"{self._schema.field(at).name} is set already")
        self._values[at] = accept(self._schema.field(at), value)
        return self

    def _typed(self, kind: DataType, column: int | str, value: Any) -> RowAppender:
        field = self._schema.field(column)
        if field.type is not kind:
            raise TypeError(f"{field.name} is {field.type.name}, not {kind.name}")
        return self.set(column, value)

    def set_int(self, column: int | str, value: int) -> RowAppender:
        return self._typed(DataType.INT, column, value)

    def set_long(self, column: int | str, value: int) -> RowAppender:
        return self._typed(DataType.LONG, column, value)

    def set_float(self, column: int | str, value: float) -> RowAppender:
        return self._typed(DataType.FLOAT, column, value)

    def set_double(self, column: int | str, value: float) -> RowAppender:
        return self._typed(DataType.DOUBLE, column, value)

    def set_boolean(self, column: int | str, value: bool) -> RowAppender:
        return self._typed(DataType.BOOLEAN, column, value)

    def set_string(self, column: int | str, value: str) -> RowAppender:
        return self._typed(DataType.STRING, column, value)

    def set_instant(self, column: int | str, value: datetime | int) -> RowAppender:
        return self._typed(DataType.INSTANT, column, value)

    set_epoch_nano = set_instant

    def set_double_array(self, column: int | str, value: list[float]) -> RowAppender:
        return self._typed(DataType.DOUBLE_ARRAY, column, value)

    def set_int_array(self, column: int | str, value: list[int]) -> RowAppender:
        return self._typed(DataType.INT_ARRAY, column, value)

    def set_string_array(self, column: int | str, value: list[str | None]) -> RowAppender:
        return self._typed(DataType.STRING_ARRAY, column, value)

    def set_date_array(self, column: int | str, value: list) -> RowAppender:
        return self._typed(DataType.DATE_ARRAY, column, value)

    def set_null(self, column: int | str) -> RowAppender:
        return self.set(column, None)

    def commit(self) -> None:
        if self._done:
            raise RuntimeError("the row is committed already")
        self._done = True
        self._take(tuple(self._values.get(i) for i in range(len(self._schema))))


def epoch_nanos(value: datetime | int) -> int:
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        d = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
        value = ((d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds) * 1000
    if not -(1 << 63) <= int(value) < 1 << 63:
        raise OverflowError(f"instant out of range: {value}")
    return int(value)


def _wrapped(value: Any, bits: int) -> int:
    """A number as an integer of so many bits: fractions are cut off, the rest wraps as two's complement does."""
    whole = int(value) if not isinstance(value, float) or math.isfinite(value) else 0
    return (whole + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def accept(field: Field, value: Any) -> Any:
    """A value as the column stores it, or an error."""
    if value is None:
        return None
    kind = field.type
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind.is_numeric:
        if not number:
            raise TypeError(f"{field.name}: {value!r} is no number")
        if kind is DataType.INT:
            return _wrapped(value, 32)
        return _wrapped(value, 64) if kind is DataType.LONG else float(value)
    if kind is DataType.BOOLEAN:
        if not isinstance(value, bool):
            raise TypeError(f"{field.name}: {value!r} is no boolean")
        return value
    if kind is DataType.STRING:
        return value if isinstance(value, str) else str(value)
    if kind is DataType.INSTANT:
        if not number and not isinstance(value, datetime):
            raise TypeError(f"{field.name}: {value!r} is no instant")
        return epoch_nanos(value)
    items = list(value)
    if len(items) != field.array_length:
        raise ValueError(f"{field.name}: {len(items)} elements, not {field.array_length}")
    if kind is DataType.STRING_ARRAY:
        return [None if x is None else str(x) for x in items]
    if any(x is None for x in items):
        raise ValueError(f"{field.name}: null element")
    if kind is DataType.DOUBLE_ARRAY:
        return [float(x) for x in items]
    return [epoch_nanos(x) for x in items] if kind is DataType.DATE_ARRAY else [_wrapped(x, 32) for x in items]


class DerivedTable(Table):
    """A plan as a table.  The last slice is kept, for its viewport and its sources' versions."""

    def __init__(self, root: Operator, context: Context | None = None):
        self.root, self.schema, self._context = root, root.schema, context or Context()
        self._lock = threading.RLock()
        self._memo: tuple[Viewport, tuple[int, ...], Slice] | None = None

    def base_tables(self) -> list[Table]:
        return self.root.tables()

    def versions(self) -> tuple[int, ...]:
        return tuple(t.version for t in self.base_tables())

    @property
    def version(self) -> int:
        return sum(self.versions())

    @property
    def size(self) -> int:
        return self.read(ALL).row_count

    def frame(self) -> DataFrame:
        return self.root.frame(self._context)

    def read(self, viewport: Viewport = ALL) -> Slice:
        with self._lock:
            versions = self.versions()
            if self._memo and self._memo[0] == viewport and self._memo[1] == versions:
                return self._memo[2]
            out = finish(self.root.frame(self._context, viewport.rows), self.schema, viewport, sum(versions))
            self._memo = (viewport, versions, out)
            return out

    def invalidate(self) -> None:
        with self._lock:
            self._memo = None

    def explain(self, mode: str = "formatted") -> None:
        self.read().to_df().explain(mode)

    def subscribe(self, viewport: Viewport, on_change: Callable[[Slice], None]) -> Subscription:
        """One delivery now, and one after every change of any source, whether or not it shows."""

        def listener(_: int) -> None:
            self.invalidate()
            held.deliver()

        sources = [t for t in self.base_tables() if hasattr(t, "add_listener")]
        held = Subscription(self, viewport, on_change, lambda: [t.remove_listener(listener) for t in sources])
        for t in sources:
            t.add_listener(listener)
        held.deliver()
        return held
