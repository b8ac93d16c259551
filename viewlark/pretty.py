"""Text tables: header, types, rule, rows, and a footer that says what is not shown."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from .schema import DataType, Field

if TYPE_CHECKING:
    from .tables import Slice

#: Fixed values of the layout.
MAX_ROWS, MAX_COLS, MAX_CELL_WIDTH, NULL, ELLIPSIS = 20, 10, 40, "null", "..."


def instant(nanos: int) -> str:
    """ISO-8601, with as many digits of a second (in threes) as there are."""
    from datetime import datetime, timedelta, timezone

    seconds, rest = divmod(nanos, 1_000_000_000)
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
    digits = f"{rest:09d}"
    digits = "" if not rest else digits[:3] if digits.endswith("000000") else digits[:6] if digits.endswith("000") else digits
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{digits}" if digits else "") + "Z"


def cell(field: Field, value: Any, width: int) -> str:
    return clip(_text(field.type, value), width)


def _text(kind: DataType, value: Any) -> str:
    if value is None:
        return NULL
    if kind is DataType.BOOLEAN:
        return "true" if value else "false"
    if kind is DataType.INSTANT:
        return instant(value)
    if kind is DataType.DATE_ARRAY:
        return "[" + ",".join(instant(v) for v in value) + "]"
    if isinstance(value, list):
        return "[" + ",".join(NULL if v is None else str(v) for v in value) + "]"
    return str(value)


def clip(text: str, width: int) -> str:
    if len(text) <= width:
        return text
    return text[:width] if width <= len(ELLIPSIS) else text[: width - len(ELLIPSIS)] + ELLIPSIS


def _many(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def _lines(table: list[list[str]], more: bool) -> list[str]:
    widths = [max(len(r[c]) for r in table) for c in range(len(table[0]))]
    said = [" | ".join(v.ljust(w) for v, w in zip(r, widths)) + (f" | {ELLIPSIS}" if more else "") for r in table]
    rule = "-+-".join("-" * w for w in widths) + ("-+----" if more else "")
    return [*said[:2], rule, *said[2:]]


def format_slice(s: Slice, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS, max_cell_width: int = MAX_CELL_WIDTH) -> str:
    fields, total = s.schema.fields[:max_cols], s.row_count
    rows = s.head(max_rows)
    label = lambda f: f.type.name + (f"[{f.array_length}]" if f.array_length else "")
    table = [["#", *(clip(f.name, max_cell_width) for f in fields)], ["", *map(label, fields)]]
    table += [[str(i), *(cell(f, r[f.name], max_cell_width) for f in fields)] for i, r in enumerate(rows)]
    hidden = len(s.schema) > max_cols
    out = _lines(table, hidden)
    if total > len(rows):
        out.append(f"... ({_many(total - len(rows), 'more row')})")
    shown = f", showing first {len(fields)}" if hidden else ""
    out.append(f"[{_many(total, 'row')} × {_many(len(s.schema), 'column')}{shown}, version={s.version}]")
    return "\n".join(out) + "\n"


def format_column(s: Slice, name: str, max_rows: int = MAX_ROWS, max_cell_width: int = MAX_CELL_WIDTH) -> str:
    field, total = s.schema.field(name), s.row_count
    rows = s.head(max_rows)
    table = [["#", name], ["", field.type.name], *([str(i), cell(field, r[name], max_cell_width)] for i, r in enumerate(rows))]
    out = _lines(table, False)
    if total > len(rows):
        out.append(f"... ({total - len(rows)} more)")
    return "\n".join([*out, f"[{_many(total, 'row')}]"]) + "\n"
