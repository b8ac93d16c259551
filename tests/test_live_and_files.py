"""Subscriptions, memo, caches, ticks, streams, residency, viewer, files."""

import json
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from viewlark import (
    BaseTable, CachedDerived, DataType, Field, Format, JoinKind, MaterializationCache, RowRange, Schema, Viewport, count, double_gt,
    from_table, pull_caching, pull_direct, read, sum_, write,
)
from viewlark.sources import csv, parquet
from viewlark.sources.wide_book import WideBookTable
from viewlark.storage import Residency, ResidencyManager
from viewlark.streaming import DependencyGraph, DirtyTracker, TickCoordinator
from viewlark.viewer import serve

SCHEMA = Schema([Field("id", DataType.LONG), Field("symbol", DataType.STRING), Field("price", DataType.DOUBLE)])


def live(spark, rows=()):
    t = BaseTable.create(spark, SCHEMA)
    for r in rows:
        t.append_row(*r)
    return t


def test_memo_and_invalidation(spark):
    t = live(spark, [(1, "A", 1.0)])
    d = from_table(t).filter(double_gt("price", 0)).build()
    first = d.read()
    assert d.read() is first and d.read(Viewport(limit=1)) is not first
    t.append_row(2, "B", 2.0)
    assert d.read().rows() == [(1, "A", 1.0), (2, "B", 2.0)] and d.version == 2 and d.size == 2


def test_subscriptions_count_every_append(spark):
    t = live(spark)
    seen, all_seen = [], []
    derived = from_table(t).filter(double_gt("price", 10)).project("id").build()
    held = derived.subscribe(Viewport(), lambda s: seen.append((s.version, s.column("id"))))
    base = t.subscribe(Viewport(rows=RowRange.head(1)), lambda s: all_seen.append(s.row_count))
    t.append_row(1, "A", 20.0)
    t.append_row(2, "B", 5.0)  # does not pass, is delivered all the same
    assert seen == [(0, []), (1, [1]), (2, [1])] and all_seen == [0, 1, 1]
    held.update_viewport(Viewport(limit=0))
    assert seen[-1] == (2, [])
    held.close()
    held.close()
    held.update_viewport(Viewport())
    t.append_row(3, "C", 30.0)
    assert len(seen) == 4 and not held.is_active and len(all_seen) == 4
    base.close()


def test_derived_over_derived_follows_the_source(spark):
    t = live(spark)
    dim = BaseTable.builder(spark, Schema([Field("s", DataType.STRING), Field("sector", DataType.STRING)])).append_row("A", "TECH").build()
    inner = from_table(t).join(dim, "symbol", "s", JoinKind.LEFT).build()
    seen = []
    outer = from_table(inner).group_by("sector", count("n"), sum_("price", "p")).build()
    outer.subscribe(Viewport(), lambda s: seen.append(s.rows()))
    t.append_row(1, "A", 2.0)
    t.append_row(2, "A", 3.0)
    assert seen == [[], [("TECH", 1, 2.0)], [("TECH", 2, 5.0)]]


def test_caches(spark):
    t = live(spark, [(1, "A", 1.0)])
    c = MaterializationCache()
    a = c.read(t, RowRange())
    assert c.read(t, RowRange()) is a and c.approximate_size() == 1
    t.append_row(2, "B", 2.0)
    assert c.read(t, RowRange()) is not a and c.approximate_size() == 1
    c.invalidate(t)
    assert c.approximate_size() == 0
    root = from_table(t).filter(double_gt("price", 1)).root
    assert pull_direct(root).rows() == pull_caching(root).rows() == [(2, "B", 2.0)]
    own = CachedDerived.of(root)
    assert own.table.read().row_count == 1 and own.cache.approximate_size() == 1
    own.invalidate_all()
    assert own.cache.approximate_size() == 0


def test_dependencies_and_ticks(spark):
    t, other, ran = live(spark), live(spark), []
    run = lambda: ran.append(1)
    graph = DependencyGraph()
    tracker = DirtyTracker(graph)
    held = tracker.watch(t, run)
    tracker.watch(t, run)  # counts once
    tracker.mark_dirty(t)
    tracker.mark_dirty(other)
    assert ran == [1]
    held.close()
    held.close()
    graph.fire(t)
    assert ran == [1]
    ticks = TickCoordinator(capacity=3)
    for _ in range(3):
        ticks.enqueue(run)
    with pytest.raises(OverflowError):
        ticks.enqueue(run)
    assert ticks.approximate_backlog == 3 and ticks.drain_blocking(2) == 2 and ticks.drain_blocking() == 1
    ticks.enqueue(run)
    with ThreadPoolExecutor(1) as pool:
        assert ticks.drain_async_on(pool).result() == 1
    done = __import__("threading").Event()
    ticks.enqueue(done.set)
    with ticks.schedule_drain(0.01):
        assert done.wait(5)
    ticks.close()
    with pytest.raises(RuntimeError):
        ticks.enqueue(run)


def test_residency(spark):
    m = ResidencyManager(100)
    a, b = m.admit(spark.range(3), 60), m.admit(spark.range(4), 60)
    assert m.residency(a) is Residency.WARM and m.residency(b) is Residency.HOT and m.hot_bytes == 60
    with m.pin(a) as pinned:
        assert pinned.df.count() == 3 and m.residency(a) is Residency.HOT and m.residency(b) is Residency.WARM
        m.touch(b)
        assert m.residency(a) is Residency.HOT
    m.remove(a)
    with pytest.raises(KeyError):
        m.current(a)
    assert m.current(b).count() == 4
    m.close()


def test_wide_book(spark):
    t = WideBookTable(spark, ["1Y", "5Y"], 40, seed=1)
    rows = t.read().rows()
    assert len(rows) == 40 and all(abs(x) <= 25_000 for r in rows for x in r[2:]) and rows[13][:2] == ("T13", "BOOK_3")
    seen = []
    with t.subscribe(Viewport(limit=1), lambda s: seen.append(s.version)):
        t.apply_global_tick()
    t.apply_global_tick()
    assert seen == [0, 1] and t.version == 2 and t.read().rows() == t.read().rows() != rows
    books = t.read_aggregated_by_book().rows()
    now = t.read().rows()
    assert [b[0] for b in books] == [f"BOOK_{i}" for i in range(10)]
    assert books[4][1] == pytest.approx(sum(r[2] for r in now if r[1] == "BOOK_4"))
    assert t.read_aggregated_by_book(Viewport.of_rows(2, 4)).column("book") == ["BOOK_2", "BOOK_3"]


def test_viewer(spark):
    t = WideBookTable(spark, ["1Y"], 30)
    s = serve(t)
    try:
        get = lambda path: json.loads(urllib.request.urlopen(s.url + path, timeout=60).read())
        assert get("/api/meta")["lastRow"] == 30 and get("/api/version") == {"version": 0}
        assert [r["trades"] for r in get("/api/rows?startRow=2&endRow=4")["rows"]] == ["T2", "T3"]
        assert get("/api/rows?startRow=0&endRow=5&groupBy=book")["lastRow"] == 10
        assert get("/api/rows?startRow=99")["rows"] == [] and s.rows({"startRow": "5", "endRow": "5"})[0] == 400
        with urllib.request.urlopen(s.url + "/stream", timeout=60) as events:
            assert b'"version": 0' in events.readline()
            events.readline()
            t.apply_global_tick()
            assert b'"version": 1' in events.readline()
    finally:
        s.close()


MATRIX = Schema([
    Field("i", DataType.INT), Field("l", DataType.LONG), Field("f", DataType.FLOAT), Field("d", DataType.DOUBLE), Field("b", DataType.BOOLEAN),
    Field("s", DataType.STRING), Field("ts", DataType.INSTANT),
])
ARRAYS = Schema([Field("da", DataType.DOUBLE_ARRAY, 2), Field("ia", DataType.INT_ARRAY, 3), Field("sa", DataType.STRING_ARRAY, 2), Field("ta", DataType.DATE_ARRAY, 2)])
EXTREMES = [
    (-(2**31), 2**63 - 1, 1.5, float("inf"), True, "ünï,\"q\"\nline", 1_600_000_000_123_456_789), (None,) * 7,
    (2**31 - 1, -(2**63), -0.25, -1e300, False, "x", -1), (0, 0, 0.0, 0.1, None, "true", 0),
]
LISTS = [([1.5, -2.0], [1, 2, 3], ["a", None], [1, -1]), (None, None, None, None), ([0.0, 1e300], [0, 0, -1], ["é", ""], [2**62, 0])]


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("fmt", [Format.ARROW, Format.PARQUET])
def test_round_trips(spark, tmp_path, fmt, single):
    for name, schema, rows in (("m", MATRIX, EXTREMES), ("a", ARRAYS, LISTS), ("e", MATRIX, [])):
        t, path = BaseTable.builder(spark, schema).append_rows(rows).build(), str(tmp_path / name)
        write(t, fmt, path, single)
        back = read(spark, fmt, path)
        assert back.schema == schema and back.read().rows() == rows, name


def test_csv_round_trip(spark, tmp_path):
    t, path = BaseTable.builder(spark, MATRIX).append_rows(EXTREMES).build(), str(tmp_path / "c")
    write(t, Format.CSV, path, single=True)
    assert read(spark, Format.CSV, path, MATRIX).read().rows() == EXTREMES
    with pytest.raises(ValueError):
        write(BaseTable.builder(spark, ARRAYS).build(), Format.CSV, str(tmp_path / "x"))


def test_csv_inference_and_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e,f,g\n1,3000000000,1.5,x,,true,2020-01-01T00:00:00Z\n-2,1,NaN,"y,""z""",,false,\n\n')
    t = read(spark, Format.CSV, str(path))
    assert [f.type.name for f in t.schema.fields] == ["INT", "LONG", "DOUBLE", "STRING", "INT", "STRING", "STRING"]
    assert t.read().column("d") == ["x", 'y,"z"'] and t.read().column("e") == [None, None] and t.size == 2
    own = Schema([Field("c", DataType.DOUBLE), Field("zz", DataType.LONG), Field("a", DataType.LONG), Field("g", DataType.INSTANT), Field("f", DataType.BOOLEAN)])
    rows = csv.read(spark, str(path), own).read().rows()
    assert rows[0] == (1.5, None, 1, 1577836800000000000, True) and rows[1][1:] == (None, -2, None, False)
    with pytest.raises(Exception, match="no LONG"):
        csv.read(spark, str(path), Schema([Field("c", DataType.LONG)])).read().rows()


def test_foreign_files(spark, tmp_path):
    plain = pa.table({"t": pa.array([1, 1500], pa.timestamp("ns")), "v": pa.array([[1, 2], [3, 4]], pa.list_(pa.int32(), 2))})
    with pa.ipc.new_file(str(tmp_path / "one.arrow"), plain.schema) as out:
        out.write_table(plain)
    got = read(spark, Format.ARROW, str(tmp_path / "one.arrow"))
    assert got.read().rows() == [(1, [1, 2]), (1500, [3, 4])] and got.schema.field("t").type is DataType.INSTANT
    import base64
    import struct

    import pyarrow.parquet as pq

    coded = pa.table({"my_x__DARR2": [base64.b64encode(struct.pack(">2d", 1.5, -2.0)).decode(), None], "t": pa.array([7, 8], pa.timestamp("ns", "UTC"))})
    pq.write_table(coded, str(tmp_path / "p.parquet"))
    back = parquet.read_encoded(spark, str(tmp_path / "p.parquet"))
    assert back.schema.field("my_x").array_length == 2 and back.read().rows() == [([1.5, -2.0], 7), (None, 8)]


def test_one_read_of_a_shared_source(spark, monkeypatch):
    from viewlark.cache import CachedDerived
    from viewlark.operators.core import Context

    reads, plain = [], Context.read
    monkeypatch.setattr(Context, "read", lambda self, table, rows: reads.append(table) or plain(self, table, rows))
    t = BaseTable.builder(spark, Schema([Field("k", DataType.STRING)])).append_rows([("a",), ("a",), ("b",)]).build()
    plan = from_table(t).join(from_table(t).group_by("k", count("n")), "k", "k")
    assert CachedDerived.of(plan.root).table.read().rows() == [("a", 2), ("a", 2), ("b", 1)] and reads == [t]


def test_some_columns_of_arrow_files(spark, tmp_path):
    from viewlark.sources import Format, arrow_ipc, write

    t = BaseTable.of(spark.range(10).selectExpr("id", "id * 2 AS b", "string(id) AS s"), order=["id"])
    write(t, Format.ARROW, str(tmp_path / "a"))
    assert arrow_ipc.read(spark, str(tmp_path / "a"), ["s", "id"]).read().rows()[3] == ("3", 3)
    assert arrow_ipc.read(spark, str(tmp_path / "a")).read().rows()[4] == (4, 8, "4")


def test_many_ticks_keep_the_plan_short(spark):
    from viewlark.sources.wide_book import WideBookTable

    book, short = WideBookTable(spark, ["x"], 20), []
    for _ in range(18):
        book.apply_global_tick()
        short.append(book.frame()._jdf.queryExecution().analyzed().toString().count("cos("))
    assert max(short) < 8 and book.version == 18 and book.read().row_count == 20
