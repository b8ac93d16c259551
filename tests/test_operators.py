"""Filters, expressions, joins, groups, pivots, order: behaviour on rows, and against brute force."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewlark import (
    BaseTable, Call, DataType, Field, JoinKind, RowRange, Schema, Viewport, and_, col, const, count, custom, discover_keys, double_gt,
    from_table, long_eq, long_gt, or_, required_columns, string_eq, sum_,
)
from viewlark.functions.expressions import predicate

NAN, INF = float("nan"), float("inf")
SALES = Schema([Field("id", DataType.LONG), Field("product", DataType.STRING), Field("amount", DataType.DOUBLE)])
SOLD = [(21, "lamp", 0.5), (22, "desk", 9.5), (23, "shelf", 4.0), (24, "lamp", 2.25)]


def table(spark, schema, rows):
    return BaseTable.builder(spark, schema).append_rows(rows).build()


def of(spark, spec, rows):
    kinds = {"l": DataType.LONG, "d": DataType.DOUBLE, "s": DataType.STRING, "i": DataType.INT, "b": DataType.BOOLEAN}
    return table(spark, Schema([Field(x[:-2], kinds[x[-1]]) for x in spec.split()]), rows)


def read(plan, viewport=None):
    return plan.build().read(viewport or Viewport()).rows()


def test_named_predicates(spark):
    t = of(spark, "id:l x:d s:s", [(1, 1.0, "a"), (2, NAN, "b"), (None, None, None), (4, 9.0, "A")])
    ids = lambda p: [r[0] for r in read(from_table(t).filter(p))]
    assert ids(long_gt("id", 1)) == [2, 4] and ids(long_eq("id", 4)) == [4]
    assert ids(double_gt("x", 0.5)) == [1, 4] and ids(string_eq("s", "a")) == [1]
    assert ids(and_(long_gt("id", 1), double_gt("x", 0))) == [4] and ids(or_(long_eq("id", 1), string_eq("s", "A"))) == [1, 4]
    assert ids(custom(["s"], lambda s: s.isin("b"))) == [2]
    for bad in (long_gt("x", 1), double_gt("id", 1), string_eq("id", "1")):
        with pytest.raises(TypeError):
            from_table(t).filter(bad)
    with pytest.raises(KeyError):
        from_table(t).filter(long_gt("nope", 1))
    with pytest.raises(ValueError):
        string_eq("s", None)


def test_exact_longs_in_predicates_and_doubles_in_expressions(spark):
    t = of(spark, "n:l", [(2**53,), (2**53 + 1,)])
    assert len(read(from_table(t).filter(long_eq("n", 2**53)))) == 1
    assert len(read(from_table(t).filter_expr(col("n").eq(2**53)))) == 2


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.sampled_from([None, NAN, 0.0, -0.0, 1.0, -2.5, INF, -INF])] * 2), min_size=1, max_size=12))
def test_two_valued_logic_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double")
    a, b = col("a"), col("b")
    plain = lambda f: lambda x, y: x is not None and y is not None and not math.isnan(x) and not math.isnan(y) and f(x, y)
    lt, eq = plain(lambda x, y: x < y), plain(lambda x, y: x == y)
    cases = [
        (a < b, lt), (a <= b, plain(lambda x, y: x <= y)), (a > b, plain(lambda x, y: x > y)), (a >= b, plain(lambda x, y: x >= y)),
        (a.eq(b), eq), (a.ne(b), lambda x, y: not eq(x, y)), (~(a < b), lambda x, y: not lt(x, y)),
        ((a < b) | ~a.eq(1), lambda x, y: lt(x, y) or not eq(x, 1.0)), ((a < b) & b.ne(0), lambda x, y: lt(x, y) and not eq(y, 0.0)),
    ]
    t = BaseTable.of(df, order=["i"])
    conditions = [predicate(e).column(t.schema).alias(f"c{k}") for k, (e, _) in enumerate(cases)]
    got = df.select("i", *conditions).orderBy("i").collect()
    for r, (x, y) in zip(got, rows):
        assert [r[f"c{k}"] for k in range(len(cases))] == [f(x, y) for _, f in cases]
    kept = [r[0] for r in read(from_table(t).filter_expr(cases[5][0]))]
    assert kept == [i for i, (x, y) in enumerate(rows) if cases[5][1](x, y)]


def test_arithmetic(spark):
    t = of(spark, "a:d b:d n:i", [(5.0, 0.0, 2**31 - 1), (-5.0, 0.0, 1), (0.0, 0.0, 2), (1.7e308, 2.0, 3), (None, 1.0, 4), (5.0, -0.0, 5)])
    value = lambda e: [r[-1] for r in read(from_table(t).with_column("v", e))]
    div = value(col("a") / col("b"))
    assert div[:2] == [INF, -INF] and math.isnan(div[2]) and div[3] == 1.7e308 / 2 and div[4] is None and div[5] == -INF
    assert value(col("a") * 10)[3] == INF and value(col("n") + 1)[0] == 2.0**31
    assert str(value(-col("a"))[2]) == "-0.0" and value(1 - col("b"))[3] == -1.0
    assert read(from_table(t).filter_expr(col("a") / col("b") > 0)) == [(5.0, 0.0, 2**31 - 1), (1.7e308, 2.0, 3)]
    assert required_columns((col("a") + col("b") > col("a")) & Call("f", (col("n"),))) == ["a", "b", "n"]
    with pytest.raises(NotImplementedError):
        from_table(t).with_column("v", Call("f", ()))
    with pytest.raises(TypeError):
        from_table(of(spark, "s:s", [("x",)])).with_column("v", col("s"))
    with pytest.raises(TypeError):
        const("x")


def test_projection_chain_and_columns_of_viewports(spark):
    t = table(spark, SALES, SOLD)
    p = from_table(t).filter(double_gt("amount", 1.5)).project("amount", "id")
    assert read(p) == [(9.5, 22), (4.0, 23), (2.25, 24)]
    assert read(p, Viewport(columns=("id",), limit=2)) == [(22,), (23,)]
    assert read(p, Viewport(rows=RowRange.head(3))) == [(9.5, 22), (4.0, 23)]  # the window is of the source's rows
    again = from_table(p.build()).filter_expr(col("id") > 22)
    assert read(again) == [(4.0, 23), (2.25, 24)]
    with pytest.raises(KeyError):
        from_table(t).project("nope")


def test_order(spark):
    t = of(spark, "i:l k:d", [(0, 2.0), (1, NAN), (2, 1.0), (3, 2.0), (4, -INF), (5, 1.0)])
    ids = lambda p, v=None: [r[0] for r in read(p, v)]
    assert ids(from_table(t).order_by("k")) == [4, 2, 5, 0, 3, 1]
    assert ids(from_table(t).order_by("k", False)) == [1, 0, 3, 2, 5, 4]  # ties as they came
    assert ids(from_table(t).order_by("k"), Viewport.of_rows(1, 4)) == [2, 5, 0]
    assert ids(from_table(t).order_by("i", False).order_by("k")) == [4, 5, 2, 3, 0, 1]
    top = from_table(t).order_by("k", False).build().read(Viewport(limit=2)).to_df()
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()
    n = of(spark, "i:l k:l", [(0, 5), (1, None), (2, -(2**63)), (3, 2**63 - 1)])
    assert ids(from_table(n).order_by("k", nulls="last")) == [2, 0, 3, 1] and ids(from_table(n).order_by("k", False, nulls="first")) == [1, 3, 0, 2]
    with pytest.raises(Exception, match="null in sort key"):
        read(from_table(n).order_by("k"))
    with pytest.raises(TypeError):
        from_table(of(spark, "s:s", [("x",)])).order_by("s")


def test_deep_windows(spark, monkeypatch):
    from viewlark.operators import core

    rows = [(i, float(i * 7 % 101)) for i in range(101)]
    p = from_table(BaseTable.of(spark.createDataFrame(rows, "i long, k double").repartition(7), order=["i"])).order_by("k", False)
    views = [Viewport.of_rows(20, 30), Viewport.of_rows(95, 500), Viewport(limit=40), Viewport.of_rows(0, 3), Viewport.of_rows(500, 600)]
    before = [read(p, v) for v in views]
    monkeypatch.setattr(core, "DEEP", 2)
    assert [read(p, v) for v in views] == before
    assert before[0] == sorted(rows, key=lambda r: -r[1])[20:30] and len(before[1]) == 6 and before[4] == []


KEYS = st.sampled_from([None, "a", "b", "c"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(KEYS, max_size=6), st.lists(KEYS, max_size=6), st.sampled_from(list(JoinKind)))
def test_joins_against_brute_force(spark, left, right, kind):
    a = of(spark, "k:s va:l", [(k, i) for i, k in enumerate(left)])
    b = of(spark, "k2:s vb:l", [(k, i) for i, k in enumerate(right)])
    hits = [(k, i, j) for i, k in enumerate(left) for j, q in enumerate(right) if k is not None and k == q]
    if kind is JoinKind.RIGHT:
        want = []
        for j, q in enumerate(right):
            own = [(k, i, jj) for k, i, jj in hits if jj == j]
            want += own or ([(None, None, j)] if q is not None else [])
    else:
        want = []
        for i, k in enumerate(left):
            own = [h for h in hits if h[1] == i]
            want += own or ([(k, i, None)] if k is not None and kind is not JoinKind.INNER else [])
        if kind is JoinKind.FULL:
            want += [(None, None, j) for j in range(len(right)) if j not in {h[2] for h in hits}]
    assert sorted(map(str, read(from_table(a).join(b, "k", "k2", kind)))) == sorted(map(str, want))
    if kind is not JoinKind.FULL:
        assert read(from_table(a).join(b, "k", "k2", kind)) == want  # in order


def test_join_schema(spark):
    a, b = of(spark, "k:s x:l", [("a", 1)]), of(spark, "k:s x:l", [("a", 2)])
    with pytest.raises(ValueError):
        from_table(a).join(b, "k", "k")
    c = of(spark, "k:s y:l", [("a", 2)])
    assert from_table(a).join(c, "k", "k").schema.names == ["k", "x", "y"]
    assert read(from_table(a).join(from_table(c).filter(long_gt("y", 1)), "k", "k")) == [("a", 1, 2)]
    with pytest.raises(TypeError):
        from_table(a).join(c, "x", "k")


def test_groups(spark):
    t = of(spark, "g:s v:d", [("A", 10.0), (None, 20.0), ("B", None), ("A", 30.0), ("B", None), ("C", NAN)])
    got = read(from_table(t).group_by("g", count("n"), sum_("v", "s")))
    assert got[:2] == [("A", 2, 40.0), ("B", 2, 0.0)] and got[2][0] == "C" and math.isnan(got[2][2])
    assert read(from_table(t).filter(string_eq("g", "zz")).group_by("g", count("n"))) == []
    having = from_table(t).group_by("g", count("n"), sum_("v", "s")).filter(double_gt("s", 1)).with_column("mean", col("s") / col("n"))
    assert read(having) == [("A", 2, 40.0, 20.0)]
    assert read(from_table(t).group_by("g", count("n")), Viewport.of_rows(1, 2)) == [("B", 2)]
    for bad in (lambda p: p.group_by("v", count("n")), lambda p: p.group_by("g", sum_("g", "s"))):
        with pytest.raises(TypeError):
            bad(from_table(t))
    with pytest.raises(ValueError):
        from_table(t).group_by("g")


def test_pivot(spark):
    t = of(spark, "r:s c:s v:d", [("US", "x", 10.0), ("EU", "z", 1.0), ("EU", "y", 40.0), ("US", "x", 5.0), ("JP", "q", 7.0), ("CN", "x", None), ("FR", "x", NAN), (None, "x", 3.0)])
    got = read(from_table(t).pivot("r", "c", "v", ["x", "y", "w"]))
    assert got[:2] == [("US", 15.0, 0.0, 0.0), ("EU", 0.0, 40.0, 0.0)] and got[2][0] == "FR" and math.isnan(got[2][1]) and got[2][2] == 0.0 and len(got) == 3
    assert discover_keys(t.frame(), "c") == ["x", "z", "y", "q"]
    assert read(from_table(t).pivot("r", "c", "v", ["x", "y"]), Viewport(columns=("y",), limit=1)) == [(0.0,)]
    with pytest.raises(ValueError):
        from_table(t).pivot("r", "c", "v", ["x", "x"])
    with pytest.raises(ValueError):
        from_table(t).pivot("r", "c", "v", ["r"])


def test_arrays_pass_through_everything(spark):
    s = Schema([Field("k", DataType.STRING), Field("n", DataType.LONG), Field("x", DataType.INT_ARRAY, 2), Field("y", DataType.STRING_ARRAY, 1)])
    t = table(spark, s, [("a", 2, [1, 2], [None]), ("b", 1, [3, 4], ["q"]), ("a", 0, None, ["r"])])
    other = of(spark, "k2:s z:l", [("a", 7)])
    p = from_table(t).filter(long_gt("n", -1)).join(other, "k", "k2").order_by("n")
    assert read(p) == [("a", 0, None, ["r"], 7), ("a", 2, [1, 2], [None], 7)]


def test_plans_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit("s").alias("unused")).write.parquet(path)
    df = from_table(spark.read.parquet(path)).filter(double_gt("x", 3)).filter_expr(col("id") > 10).project("id").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3.0)" in plan and "unused" not in plan and "Sort" not in plan
    assert df.count() == sum(1 for i in range(1000) if i % 7 > 3 and i > 10)
