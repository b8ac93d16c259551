"""Slices as JSON for data grids.  Numbers that JSON lacks (NaN, infinities) are null; instants are ISO text."""

from __future__ import annotations

import json
import math
from typing import Any

from . import pretty
from .schema import DataType, Schema
from .tables import Slice


def column_defs(schema: Schema) -> list[dict]:
    out = []
    for f in schema.fields:
        own: dict[str, Any] = {"headerName": f.name, "field": f.name, "filter": True, "sortable": True, "resizable": True}
        if f.type.is_numeric:
            own["cellDataType"] = "number"
        elif f.type is DataType.DOUBLE_ARRAY:
            own["cellDataType"] = "numberArray"
        out.append(own)
    return out


def _value(kind: DataType, v: Any) -> Any:
    if isinstance(v, list):
        return [_value(DataType.INSTANT if kind is DataType.DATE_ARRAY else DataType.STRING, x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if kind is DataType.INSTANT and v is not None:
        return pretty.instant(v)
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def row_data(s: Slice) -> list[dict]:
    return [{f.name: _value(f.type, r[f.name]) for f in s.schema.fields} for r in s.collect()]


def _json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def to_grid_payload(s: Slice) -> str:
    return _json({"columnDefs": column_defs(s.schema), "rowData": row_data(s), "version": s.version, "rowCount": s.row_count})


def meta_json(schema: Schema, total_rows: int) -> str:
    return _json({"columnDefs": column_defs(schema), "lastRow": total_rows})


def infinite_block(s: Slice, last_row: int) -> str:
    return _json({"rows": row_data(s), "version": s.version, "lastRow": last_row})
