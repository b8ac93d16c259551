"""Schemas, viewports, tables, slices, text."""

from datetime import datetime, timezone

import pytest

from viewlark import BaseTable, DataType, Field, RowRange, Schema, SortKey, Viewport
from viewlark import grid, pretty

TRADES = Schema.builder().add("id", DataType.LONG).add("symbol", DataType.STRING).add("price", DataType.DOUBLE).build()
ROWS = [(11, "maple", 3.5), (12, "elm", 0.25), (13, "maple", 8.0), (14, "fir", 1.75), (15, "elm", 6.0)]


def trades(spark):
    return BaseTable.builder(spark, TRADES).append_rows(ROWS).build()


def test_schema_rules():
    assert TRADES.names == ["id", "symbol", "price"] and TRADES.index_of("price") == 2
    assert TRADES.select(["price", "id"]).names == ["price", "id"]
    with pytest.raises(ValueError):
        Schema.builder().build()
    with pytest.raises(ValueError):
        Schema([Field("a", DataType.INT), Field("a", DataType.LONG)])
    with pytest.raises(KeyError):
        TRADES.field("nope")
    with pytest.raises(ValueError):
        Field("a", DataType.DOUBLE_ARRAY)
    with pytest.raises(ValueError):
        Field("a", DataType.INT, 3)
    with pytest.raises(ValueError):
        Field("o", DataType.OBJECT).to_spark()
    own = Schema([Field("t", DataType.INSTANT), Field("x", DataType.DOUBLE_ARRAY, 3), Field("s", DataType.STRING_ARRAY, 2), Field("d", DataType.DATE_ARRAY, 2)])
    assert Schema.from_spark(own.to_spark()) == own


def test_row_ranges_and_viewports():
    assert RowRange.of(2, 5).intersect(RowRange.head(4)) == RowRange.of(2, 4)
    assert RowRange.of(6, 9).intersect(RowRange.head(4)).size == 0
    assert RowRange().is_all and not RowRange.head(3).is_all
    with pytest.raises(ValueError):
        RowRange.of(3, 2)
    with pytest.raises(ValueError):
        Viewport(limit=-1)
    a = Viewport.builder().rows(0, 5).columns("x").order(SortKey.asc("x")).limit(3).build()
    b = Viewport.builder().rows(3, 9).columns("y", "x").build()
    assert a == Viewport(RowRange(0, 5), ("x",), (SortKey("x"),), 3) and hash(a) == hash(Viewport(RowRange(0, 5), ("x",), (SortKey("x"),), 3))
    assert a.union(b) == Viewport(RowRange(0, 9), ("x", "y"))
    assert a.union(Viewport.all()).columns is None


def test_sealed_table(spark):
    t = trades(spark)
    assert t.version == 0 and t.size == 5 and t.is_sealed
    assert t.read().rows() == ROWS
    assert t.read(Viewport.of_rows(1, 3)).rows() == ROWS[1:3]
    assert t.read(Viewport.of_rows(4, 100)).rows() == ROWS[4:]
    assert t.read(Viewport.of_rows(50, 60)).rows() == []
    assert t.read(Viewport(columns=("price", "id"), limit=2)).rows() == [(3.5, 11), (0.25, 12)]
    assert t.read(Viewport(limit=0)).rows() == []
    assert t.read(Viewport(order=(SortKey.desc("price"),), limit=2)).column("id") == [13, 15]
    with pytest.raises(RuntimeError):
        t.append_row(6, "X", 1.0)
    with pytest.raises(KeyError):
        t.read(Viewport.of_columns("nope"))


def test_live_table_versions_and_snapshots(spark):
    t = BaseTable.create(spark, TRADES)
    assert t.version == 0 and t.read().rows() == []
    t.append_row(*ROWS[0])
    before = t.read()
    t.append_row(*ROWS[1])
    assert (before.rows(), before.version) == (ROWS[:1], 1)
    assert (t.read().rows(), t.version) == (ROWS[:2], 2)
    t.row().set_long("id", 9).set_string("symbol", "Z").commit()
    assert t.read().rows()[2] == (9, "Z", None)
    with pytest.raises(ValueError):
        t.append_row(1, "x")
    with pytest.raises(TypeError):
        t.append_row("one", "x", 1.0)
    appender = t.row().set_long(0, 1)
    with pytest.raises(ValueError):
        appender.set_long(0, 2)
    with pytest.raises(TypeError):
        t.row().set_double("id", 2.0)
    t.seal()
    t.seal()
    with pytest.raises(RuntimeError):
        t.append_row(*ROWS[0])


def test_many_batches_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(BaseTable, "BATCH_ROWS", 3)
    t = BaseTable.create(spark, Schema([Field("n", DataType.LONG)]))
    for k in range(8):
        t.append_row(k)
    assert t.read().column("n") == list(range(8)) and t.read(Viewport.of_rows(2, 7)).column("n") == [2, 3, 4, 5, 6]


def test_frames_as_batches(spark):
    t = BaseTable.create(spark, Schema([Field("n", DataType.LONG)]))
    t.append_row(1)
    t.append_frame(spark.range(10, 13).withColumnRenamed("id", "n"))
    before = t.read()
    t.append_rows([(2,), (3,)])
    assert t.read().column("n") == [1, 10, 11, 12, 2, 3] and before.column("n") == [1, 10, 11, 12] and (t.size, t.version) == (6, 3)
    with pytest.raises(TypeError):
        t.append_frame(spark.createDataFrame([("x",)], "n string"))


def test_values_as_columns_take_them(spark):
    s = Schema([
        Field("i", DataType.INT), Field("b", DataType.BOOLEAN), Field("s", DataType.STRING), Field("t", DataType.INSTANT), Field("x", DataType.DOUBLE_ARRAY, 3),
        Field("y", DataType.STRING_ARRAY, 2), Field("d", DataType.DATE_ARRAY, 1),
    ])
    at = datetime(2020, 1, 2, 3, 4, 5, 6, tzinfo=timezone.utc)
    t = BaseTable.builder(spark, s).append_row(2**31, True, 5, at, [1, 2, 3], ["a", None], [7]).append_row(*[None] * 7).build()
    assert t.read().rows()[0] == (-(2**31), True, "5", 1577934245000006000, [1.0, 2.0, 3.0], ["a", None], [7])
    assert t.read().rows()[1] == (None,) * 7
    for bad in ([None, "yes"], [None, None, None, 1 << 70], [None, None, None, None, [1.0, 2.0]]):
        with pytest.raises((TypeError, OverflowError, ValueError)):
            BaseTable.create(spark, s).append_row(*bad, *[None] * (7 - len(bad)))


def test_pretty(spark):
    out = trades(spark).to_pretty_string()
    assert out.splitlines()[0] == "# | id   | symbol | price " and out.splitlines()[2] == "--+------+--------+-------"
    assert out.endswith("[5 rows × 3 columns, version=0]\n")
    cut = trades(spark).to_pretty_string(2, 2, 3)
    assert "... (3 more rows)" in cut and "showing first 2" in cut and "map" in cut
    assert "null" in BaseTable.builder(spark, TRADES).append_row(1, None, None).build().to_pretty_string()
    assert pretty.format_column(trades(spark).read(), "symbol", 2).endswith("... (3 more)\n[5 rows]\n")
    assert pretty.instant(1) == "1970-01-01T00:00:00.000000001Z" and pretty.instant(-1) == "1969-12-31T23:59:59.999999999Z"


def test_grid_json(spark):
    s = Schema([Field("x", DataType.DOUBLE), Field("t", DataType.INSTANT), Field("q", DataType.STRING)])
    t = BaseTable.builder(spark, s).append_row(float("nan"), 1500000000, 'a"b').append_row(1.5, None, None).build()
    body = grid.to_grid_payload(t.read())
    assert '"rowData":[{"x":null,"t":"1970-01-01T00:00:01.500Z","q":"a\\"b"},{"x":1.5,"t":null,"q":null}],"version":0,"rowCount":2}' in body
    assert '"cellDataType":"number"' in body and grid.meta_json(s, 9).endswith('"lastRow":9}')
