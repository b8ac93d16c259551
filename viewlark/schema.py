"""Column types and table schemas, and their Spark counterparts.

INSTANT is a count of nanoseconds since the epoch (Spark's own timestamps stop
at microseconds), marked in the field's metadata; array types have a fixed
length, kept there as well.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import types as T


class DataType(enum.Enum):
    INT = "int"
    LONG = "long"
    FLOAT = "float"
    DOUBLE = "double"
    BOOLEAN = "boolean"
    STRING = "string"
    INSTANT = "instant"
    DOUBLE_ARRAY = "double_array"
    INT_ARRAY = "int_array"
    STRING_ARRAY = "string_array"
    DATE_ARRAY = "date_array"
    OBJECT = "object"

    @property
    def is_array(self) -> bool:
        return self.name.endswith("_ARRAY")

    @property
    def is_numeric(self) -> bool:
        return self in (DataType.INT, DataType.LONG, DataType.FLOAT, DataType.DOUBLE)


_SPARK = {
    DataType.INT: T.IntegerType(), DataType.LONG: T.LongType(), DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(),
    DataType.BOOLEAN: T.BooleanType(), DataType.STRING: T.StringType(), DataType.INSTANT: T.LongType(),
    DataType.DOUBLE_ARRAY: T.ArrayType(T.DoubleType(), False), DataType.INT_ARRAY: T.ArrayType(T.IntegerType(), False),
    DataType.STRING_ARRAY: T.ArrayType(T.StringType(), True), DataType.DATE_ARRAY: T.ArrayType(T.LongType(), False),
}
_SCALARS = {
    "int": DataType.INT, "smallint": DataType.INT, "tinyint": DataType.INT, "bigint": DataType.LONG, "float": DataType.FLOAT,
    "double": DataType.DOUBLE, "boolean": DataType.BOOLEAN, "string": DataType.STRING,
}
_ARRAYS = {"double": DataType.DOUBLE_ARRAY, "float": DataType.DOUBLE_ARRAY, "int": DataType.INT_ARRAY, "string": DataType.STRING_ARRAY, "bigint": DataType.DATE_ARRAY}


@dataclass(frozen=True)
class Field:
    name: str
    type: DataType
    array_length: int = 0

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a column needs a name")
        if self.type.is_array != (self.array_length > 0):
            raise ValueError(f"{self.name}: array length {self.array_length} does not suit {self.type.name}")

    def to_spark(self) -> T.StructField:
        if self.type is DataType.OBJECT:
            raise ValueError(f"{self.name}: OBJECT columns can be declared but not stored")
        meta: dict = {}
        if self.type in (DataType.INSTANT, DataType.DATE_ARRAY):
            meta["logical"] = "instant_ns"
        if self.array_length:
            meta["fixed_length"] = self.array_length
        return T.StructField(self.name, _SPARK[self.type], True, meta)


class Schema:
    """Ordered fields with distinct names."""

    def __init__(self, fields: list[Field] | tuple[Field, ...]):
        self._fields = tuple(fields)
        self._at = {f.name: i for i, f in enumerate(self._fields)}
        if len(self._at) < len(self._fields):
            raise ValueError(f"duplicate column names: {[f.name for f in self._fields]}")

    @staticmethod
    def of(*fields: Field) -> Schema:
        return Schema(fields)

    @staticmethod
    def builder() -> SchemaBuilder:
        return SchemaBuilder()

    @property
    def fields(self) -> tuple[Field, ...]:
        return self._fields

    @property
    def names(self) -> list[str]:
        return [f.name for f in self._fields]

    def __len__(self) -> int:
        return len(self._fields)

    def __contains__(self, name: str) -> bool:
        return name in self._at

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self._fields == other._fields

    def __hash__(self) -> int:
        return hash(self._fields)

    def __repr__(self) -> str:
        return f"Schema({', '.join(f'{f.name} {f.type.name}' + (f'[{f.array_length}]' if f.array_length else '') for f in self._fields)})"

    def index_of(self, name: str) -> int:
        if name not in self._at:
            raise KeyError(f"no column {name!r} among {self.names}")
        return self._at[name]

    def field(self, key: int | str) -> Field:
        return self._fields[key if isinstance(key, int) else self.index_of(key)]

    def select(self, names: list[str] | tuple[str, ...]) -> Schema:
        return Schema([self.field(n) for n in names])

    def to_spark(self) -> T.StructType:
        return T.StructType([f.to_spark() for f in self._fields])

    @staticmethod
    def from_spark(struct: T.StructType) -> Schema:
        """Spark types without a counterpart (timestamps, decimals, maps) are STRING here: they pass through untouched."""
        out = []
        for f in struct:
            meta, name = f.metadata or {}, f.dataType.simpleString()
            if isinstance(f.dataType, T.ArrayType):
                kind = _ARRAYS.get(f.dataType.elementType.simpleString())
                length = meta.get("fixed_length", 0)
                out.append(Field(f.name, kind, length) if kind and length else Field(f.name, DataType.STRING))
            elif meta.get("logical") == "instant_ns":
                out.append(Field(f.name, DataType.INSTANT))
            else:
                out.append(Field(f.name, _SCALARS.get(name, DataType.STRING)))
        return Schema(out)


class SchemaBuilder:
    def __init__(self) -> None:
        self._fields: list[Field] = []

    def add(self, name: str, type: DataType, array_length: int = 0) -> SchemaBuilder:  # noqa: A002
        self._fields.append(Field(name, type, array_length))
        return self

    def build(self) -> Schema:
        if not self._fields:
            raise ValueError("a schema needs a column")
        return Schema(self._fields)
