"""The queries over the driver's tables and the DuckDB SQL that yields the same rows.

Each goes through the table API.  Sums of doubles are rounded on both sides,
since the order of summation differs; nulls and NaN, which the tables lack, are
put in by the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cache import pull_caching
from ..functions.expressions import col, const
from ..functions.predicates import and_, custom, double_gt, long_eq, long_gt, or_, string_eq
from ..operators import POS, JoinKind, count, discover_keys, sum_
from ..operators.core import numbered
from ..schema import DataType, Field, Schema
from ..shared import folder
from ..sources import Format, read, write
from ..sources.wide_book import WideBookTable
from ..streaming import StreamedTable, stream
from ..tables import BaseTable, Slice
from ..viewport import RowRange, SortKey, Viewport
from .planner import QueryPlanner, from_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plan(spark: SparkSession, sf_dir: str, name: str) -> QueryPlanner:
    """Keys of the tables are numbers, hence not strict."""
    return from_table(_load(spark, sf_dir, name), strict=False)


def _rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- filters and named predicates


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey > 700")
def filter_long_gt(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, "orders").filter(long_gt("o_custkey", 700)).project("o_orderkey", "o_custkey", "o_totalprice").to_df()


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def filter_long_eq(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, "orders").filter(long_eq("o_custkey", 7)).project("o_orderkey", "o_custkey", "o_totalprice").to_df()


@_query("""SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value
FROM events) WHERE value > 50 AND NOT isnan(value)""")
def filter_double_gt_nan(spark: SparkSession, d: str) -> DataFrame:
    return from_table(_odd_events(spark, d)).filter(double_gt("value", 50)).to_df()


def _odd_events(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    return _load(spark, d, "events").select("event_id", odd.alias("value"))


@_query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def filter_string_eq(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, "lineitem").filter(string_eq("l_returnflag", "R")).project("l_orderkey", "l_linenumber", "l_returnflag").to_df()


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    both = and_(string_eq("l_returnflag", "R"), double_gt("l_quantity", 30))
    return _plan(spark, d, "lineitem").filter(both).project("l_orderkey", "l_linenumber").to_df()


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR l_quantity > 45")
def filter_or(spark: SparkSession, d: str) -> DataFrame:
    either = or_(string_eq("l_returnflag", "A"), double_gt("l_quantity", 45))
    return _plan(spark, d, "lineitem").filter(either).project("l_orderkey", "l_linenumber").to_df()


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 AND o_custkey > 100")
def filter_chained(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").filter(string_eq("o_orderpriority", "1-URGENT")).filter(double_gt("o_totalprice", 100000))
    return p.filter(long_gt("o_custkey", 100)).project("o_orderkey").to_df()


@_query("SELECT p_partkey, p_name FROM part WHERE p_brand LIKE '%1%' AND p_size > 20")
def filter_custom(spark: SparkSession, d: str) -> DataFrame:
    own = custom(["p_brand", "p_size"], lambda b, s: b.contains("1") & (s > 20))
    return _plan(spark, d, "part").filter(own).project("p_partkey", "p_name").to_df()


# ---- expressions


@_query("SELECT l_orderkey, l_linenumber, round(-(l_extendedprice * (1 - l_discount) + l_tax), 4) AS net FROM lineitem")
def expr_arith(spark: SparkSession, d: str) -> DataFrame:
    net = -(col("l_extendedprice") * (1 - col("l_discount")) + col("l_tax"))
    return _rounded(_plan(spark, d, "lineitem").with_column("net", net).project("l_orderkey", "l_linenumber", "net").to_df(), "net", digits=4)


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN isnan(r) THEN 'nan' WHEN isinf(r) THEN 'inf' ELSE 'finite' END AS kind,
CASE WHEN isfinite(r) THEN round(r, 4) END AS ratio FROM (SELECT *, (l_tax - l_tax * (l_quantity > 25)::INT) / l_discount AS r FROM lineitem)""")
def expr_ieee_div(spark: SparkSession, d: str) -> DataFrame:
    # l_tax where the quantity is small, otherwise 0; the discount is 0 in some rows
    df = _load(spark, d, "lineitem").withColumn("part", F.when(F.col("l_quantity") > 25, 0.0).otherwise(F.col("l_tax")))
    out = from_table(df, strict=False).with_column("r", col("part") / col("l_discount")).project("l_orderkey", "l_linenumber", "r").to_df()
    kind = F.when(F.isnan("r"), "nan").when(F.abs("r") == float("inf"), "inf").otherwise("finite")
    return out.select("l_orderkey", "l_linenumber", kind.alias("kind"), F.when(kind == "finite", F.round("r", 4)).alias("ratio"))


_ODD = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value) END AS value,
event_id % 100 AS k FROM events)"""


def _floored(spark: SparkSession, d: str) -> DataFrame:
    """Whole values, so that some are equal to ``k``."""
    odd = _odd_events(spark, d)
    whole = F.when(F.isnan("value"), F.col("value")).otherwise(F.floor("value").cast("double"))
    return odd.select("event_id", F.when(F.col("value").isNotNull(), whole).alias("value"), (F.col("event_id") % 100).alias("k"))


def _compare(name: str, sql: str, make: Callable) -> None:
    total = f"coalesce(value {sql} k AND NOT isnan(value), false)"
    said = f"SELECT event_id FROM {_ODD} WHERE " + ("NOT coalesce(value = k AND NOT isnan(value), false)" if name == "expr_ne" else total)

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _floored(spark, d)
        return from_table(df).filter_expr(make(col("value"), col("k"))).project("event_id").to_df()

    run.__name__ = name
    _query(said)(run)


for _name, _sql, _make in (
    ("expr_eq", "=", lambda a, b: a.eq(b)), ("expr_ne", "<>", lambda a, b: a.ne(b)), ("expr_lt", "<", lambda a, b: a < b),
    ("expr_le", "<=", lambda a, b: a <= b), ("expr_gt", ">", lambda a, b: a > b), ("expr_ge", ">=", lambda a, b: a >= b),
):
    _compare(_name, _sql, _make)


@_query(f"""SELECT event_id FROM {_ODD}
WHERE NOT coalesce(value > 10 AND NOT isnan(value), false) OR (coalesce(value < 90 AND NOT isnan(value), false) AND k >= 50)""")
def expr_not_null_logic(spark: SparkSession, d: str) -> DataFrame:
    df = _floored(spark, d)
    said = ~(col("value") > 10) | ((col("value") < 90) & (col("k") >= 50))
    return from_table(df).filter_expr(said).project("event_id").to_df()


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000 * (1 + l_tax)")
def filter_expr_margin(spark: SparkSession, d: str) -> DataFrame:
    said = col("l_extendedprice") * (1 - col("l_discount")) > const(30000) * (1 + col("l_tax"))
    return _plan(spark, d, "lineitem").filter_expr(said).project("l_orderkey", "l_linenumber").to_df()


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40")
def filter_expr_after_join(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").join(_plan(spark, d, "customer"), "o_custkey", "c_custkey")
    return p.filter_expr(col("o_totalprice") > col("c_acctbal") * 40).project("o_orderkey", "c_name").to_df()


@_query("SELECT c_mktsegment, c_custkey, c_name FROM customer")
def project_reorder(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, "customer").project("c_mktsegment", "c_custkey", "c_name").to_df()


# ---- joins


def _sides(spark: SparkSession, d: str, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Urgent orders and the customers of one segment, by text keys; with ``nulls`` some keys are null on both sides."""
    o = _load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_cust"), "o_totalprice")
    c = _load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("c_key"), "c_name")
    if nulls:
        o = o.withColumn("o_cust", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_cust")))
        c = c.withColumn("c_key", F.when(~F.col("c_key").endswith("1"), F.col("c_key")))
    return o, c


_O = "(SELECT o_orderkey, {key} AS o_cust, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT')"
_C = "(SELECT {key} AS c_key, c_name FROM customer WHERE c_mktsegment = 'BUILDING')"


def _join_sql(kind: str, nulls: bool) -> str:
    o = _O.format(key="CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::VARCHAR END" if nulls else "o_custkey::VARCHAR")
    c = _C.format(key="CASE WHEN NOT c_custkey::VARCHAR LIKE '%1' THEN c_custkey::VARCHAR END" if nulls else "c_custkey::VARCHAR")
    if kind in ("left", "full"):
        o = f"(SELECT * FROM {o} WHERE o_cust IS NOT NULL)"
    if kind == "right":
        c = f"(SELECT * FROM {c} WHERE c_key IS NOT NULL)"
    return f"SELECT o_orderkey, o_cust, o_totalprice, c_name FROM {o} o {kind.upper()} JOIN {c} c ON o.o_cust = c.c_key"


def _joins() -> None:
    for kind in JoinKind:
        for nulls in (False, True):

            def run(spark: SparkSession, d: str, kind: JoinKind = kind, nulls: bool = nulls) -> DataFrame:
                o, c = _sides(spark, d, nulls)
                return from_table(o).join(c, "o_cust", "c_key", kind).to_df()

            run.__name__ = f"join_{kind.value}" + "_null_keys" * nulls
            _query(_join_sql(kind.value, nulls))(run)


_joins()


@_query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_fanout(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").join(_plan(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    return p.project("o_orderkey", "o_orderpriority", "l_linenumber", "l_quantity").to_df()


@_query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
def join_then_filter(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "supplier").join(_plan(spark, d, "nation"), "s_nationkey", "n_nationkey")
    return p.filter(double_gt("s_acctbal", 5000)).project("s_suppkey", "n_name").to_df()


@_query("""SELECT c_mktsegment, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def join_then_group(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").join(_plan(spark, d, "customer"), "o_custkey", "c_custkey")
    return _rounded(p.group_by("c_mktsegment", count("n"), sum_("o_totalprice", "revenue")).to_df(), "revenue")


# ---- groups


@_query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, "orders").group_by("o_orderpriority", count("n")).to_df()


@_query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_plan(spark, d, "lineitem").group_by("l_returnflag", sum_("l_extendedprice", "total")).to_df(), "total")


@_query("""SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY l_returnflag""")
def group_multi(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "lineitem").group_by("l_returnflag", count("n"), sum_("l_extendedprice", "price"), sum_("l_quantity", "quantity"))
    return _rounded(p.to_df(), "price", "quantity")


@_query("""SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total FROM (SELECT nullif(event_type, 'error') AS event_type, value FROM events)
WHERE event_type IS NOT NULL GROUP BY event_type""")
def group_null_key(spark: SparkSession, d: str) -> DataFrame:
    df = _load(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"), "value")
    return _rounded(from_table(df).group_by("event_type", count("n"), sum_("value", "total")).to_df(), "total")


@_query("""SELECT event_type, count(*) AS n, round(coalesce(sum(CASE WHEN event_type <> 'view' THEN value END), 0), 2) AS total
FROM events GROUP BY event_type""")
def group_all_null_sum(spark: SparkSession, d: str) -> DataFrame:
    df = _load(spark, d, "events").select("event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return _rounded(from_table(df).group_by("event_type", count("n"), sum_("value", "total")).to_df(), "total")


@_query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
def having_sum(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").group_by("o_custkey", count("n"), sum_("o_totalprice", "total")).filter(double_gt("total", 1000000))
    return _rounded(p.to_df(), "total")


@_query("SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 2) AS mean FROM orders GROUP BY o_orderpriority")
def avg_from_sum_count(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "orders").group_by("o_orderpriority", count("n"), sum_("o_totalprice", "total")).with_column("mean", col("total") / col("n"))
    return _rounded(p.project("o_orderpriority", "mean").to_df(), "mean")


# ---- pivots


def _pivot_sql(table: str, row: str, column: str, value: str, keys: list[str], where: str = "true") -> str:
    cells = ", ".join(f"round(coalesce(sum({value}) FILTER ({column} = '{k}'), 0), 2) AS \"{k}\"" for k in keys)
    listed = ", ".join(f"'{k}'" for k in keys)
    return f"SELECT {row}, {cells} FROM {table} WHERE {column} IN ({listed}) AND {where} GROUP BY {row}"


@_query(_pivot_sql("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"]))
def pivot_sum_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_plan(spark, d, "lineitem").pivot("l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"]).to_df(), "F", "O")


@_query(_pivot_sql("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", ["O", "X"]))
def pivot_missing_key(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_plan(spark, d, "lineitem").pivot("l_returnflag", "l_linestatus", "l_extendedprice", ["O", "X"]).to_df(), "O", "X")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@_query(_pivot_sql("events", "user_id", "event_type", "value", _TYPES))
def pivot_discovered(spark: SparkSession, d: str) -> DataFrame:
    events = BaseTable.of(_load(spark, d, "events"))
    keys = sorted(discover_keys(events.frame(), "event_type"))
    return _rounded(from_table(events, strict=False).pivot("user_id", "event_type", "value", keys).to_df(), *keys)


# ---- order and viewports


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sort_asc(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d, True)


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_desc(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d, False)


def _places(spark: SparkSession, d: str, ascending: bool) -> DataFrame:
    """The sorted rows with their places."""
    orders = BaseTable.of(_load(spark, d, "orders"), order=["o_orderkey"])
    plan = from_table(orders).order_by("o_totalprice", ascending).project("o_orderkey", "o_totalprice")
    return numbered(plan.build().frame(), [POS], "place").select("o_orderkey", "o_totalprice", (F.col("place") + 1).alias("place"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    orders = BaseTable.of(_load(spark, d, "orders"), order=["o_orderkey"])
    p = from_table(orders).order_by("o_totalprice", False).project("o_orderkey", "o_totalprice")
    return p.build().read(Viewport(limit=25)).to_df()


def _customers(spark: SparkSession, d: str) -> BaseTable:
    return BaseTable.of(_load(spark, d, "customer"), order=["c_custkey"])


@_query("SELECT * FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 20")
def viewport_rows(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).read(Viewport.of_rows(20, 60)).to_df()


@_query("SELECT c_mktsegment, c_custkey FROM customer")
def viewport_columns(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).read(Viewport.of_columns("c_mktsegment", "c_custkey")).to_df()


@_query("SELECT * FROM customer ORDER BY c_custkey LIMIT 15")
def viewport_limit(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).read(Viewport(limit=15)).to_df()


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def viewport_order(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).read(Viewport(columns=("c_custkey", "c_acctbal"), order=(SortKey.desc("c_acctbal"),), limit=10)).to_df()


@_query("SELECT c_custkey, c_acctbal FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) WHERE c_acctbal > 5000")
def viewport_filter_window(spark: SparkSession, d: str) -> DataFrame:
    p = from_table(_customers(spark, d)).filter(double_gt("c_acctbal", 5000)).project("c_custkey", "c_acctbal")
    return p.build().read(Viewport(rows=RowRange.head(100))).to_df()


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
def viewport_sort_window(spark: SparkSession, d: str) -> DataFrame:
    return from_table(_customers(spark, d)).project("c_custkey", "c_acctbal").order_by("c_acctbal").build().read(Viewport.of_rows(5, 15)).to_df()


# ---- files


def _round_trip(fmt: Format, spark: SparkSession, df: DataFrame, schema: Schema | None = None) -> DataFrame:
    path = folder(spark)
    write(BaseTable.of(df), fmt, path)
    return read(spark, fmt, path, schema).read().to_df()


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(Format.CSV, spark, _load(spark, d, "nation"))


@_query("SELECT page_id, url, html FROM pages")
def csv_roundtrip_schema(spark: SparkSession, d: str) -> DataFrame:
    own = Schema([Field("page_id", DataType.LONG), Field("url", DataType.STRING), Field("html", DataType.STRING)])
    return _round_trip(Format.CSV, spark, _load(spark, d, "pages"), own)


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def arrow_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(Format.ARROW, spark, _load(spark, d, "customer"))


@_query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(Format.PARQUET, spark, _load(spark, d, "part"))


@_query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last, len(embedding)::INT AS n FROM embeddings")
def arrow_array_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = Field("embedding", DataType.DOUBLE_ARRAY, 64).to_spark()
    df = _load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding", metadata=own.metadata))
    out = _round_trip(Format.ARROW, spark, df)
    return out.select("vec_id", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.col("embedding")[63], 5).alias("last"), F.size("embedding").alias("n"))


# ---- wide book, liveness


@_query("""SELECT 'BOOK_' || (l_orderkey % 10)::VARCHAR AS book, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM lineitem GROUP BY 1""")
def wide_book_rollup(spark: SparkSession, d: str) -> DataFrame:
    book = F.concat(F.lit("BOOK_"), (F.col("l_orderkey") % 10).cast("string")).alias("book")
    df = _load(spark, d, "lineitem").select(book, "l_quantity", "l_extendedprice")
    return _rounded(from_table(df).group_by("book", sum_("l_quantity", "quantity"), sum_("l_extendedprice", "price")).to_df(), "quantity", "price")


@_query("SELECT 'BOOK_' || i::VARCHAR AS book, 1000::BIGINT AS n, true AS same, true AS moved, true AS kept FROM range(10) t(i)")
def wide_book_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration book after ten ticks: sums by book are those of its trades, every tick moves them, and a version stays as it is."""
    book = WideBookTable(spark, ["1Y", "10Y"], 10_000)
    sums = [count("n"), sum_("1Y", "a"), sum_("10Y", "b")]
    first = from_table(book).group_by("book", *sums).build().read().to_df().drop("n").toDF("book", "a0", "b0")
    for _ in range(9):
        book.apply_global_tick()
    ninth = book.read_aggregated_by_book().to_df().toDF("book", "a9", "b9")
    again = from_table(book).group_by("book", sum_("1Y", "again")).build().read().to_df()
    book.apply_global_tick()
    rows = from_table(book).group_by("book", *sums).build().read().to_df()
    by_book = book.read_aggregated_by_book().to_df().toDF("book", "a10", "b10")
    joined = rows.join(by_book, "book").join(first, "book").join(ninth, "book").join(again, "book")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) < 1e-3
    return joined.select(
        "book", "n", (near("a", "a10") & near("b", "b10")).alias("same"),
        (~near("a0", "a9") & ~near("a9", "a10") & ~near("b0", "b9") & ~near("b9", "b10")).alias("moved"), near("a9", "again").alias("kept"),
    )


_SEEN = "SELECT '{0}' AS seen, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events {1} GROUP BY event_type"


@_query(_SEEN.format("before", "WHERE event_type <> 'purchase' AND event_type <> 'view'") + " UNION ALL " + _SEEN.format("after", ""))
def live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A live table that takes all events in two batches: what was read in between stays, what is read then has all."""
    events = _load(spark, d, "events").select("event_id", "event_type", "value")
    late = F.col("event_type").isin("purchase", "view")
    live = BaseTable.create(spark, Schema([Field("event_id", DataType.LONG), Field("event_type", DataType.STRING), Field("value", DataType.DOUBLE)]))
    grouped = from_table(live).group_by("event_type", count("n"), sum_("value", "total")).build()
    live.append_frame(events.filter(~late))
    before = grouped.read().to_df()
    live.append_frame(events.filter(late))
    after = grouped.read().to_df()
    seen = before.select(F.lit("before").alias("seen"), "*").unionByName(after.select(F.lit("after").alias("seen"), "*"))
    return _rounded(seen, "total")


def _streamed(spark: SparkSession, d: str, plan: Callable[[QueryPlanner], QueryPlanner]) -> DataFrame:
    """Events in four files, one a micro-batch; the result after the last."""
    base = folder(spark)
    schema = Schema([Field("event_id", DataType.LONG), Field("event_type", DataType.STRING), Field("user_id", DataType.LONG), Field("value", DataType.DOUBLE)])
    _load(spark, d, "events").select(*schema.names).repartition(4).write.parquet(f"{base}/in")
    table = StreamedTable(spark, f"{base}/in", schema, files_per_batch=1)
    root = plan(from_table(table, strict=False)).root

    def last(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{batch:06d}")

    query = stream(root, last, f"{base}/progress", available_now=True)
    query.awaitTermination()
    n = query.lastProgress.batchId if query.lastProgress else 0
    return spark.read.parquet(f"{base}/out/{n:06d}")


@_query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def live_group_stream(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_streamed(spark, d, lambda p: p.group_by("event_type", count("n"), sum_("value", "total"))), "total")


@_query("""SELECT kind, count(*) AS n, round(sum(value), 2) AS total FROM events
JOIN (VALUES ('click', 'use'), ('view', 'use'), ('purchase', 'sale')) t(k, kind) ON event_type = k GROUP BY kind""")
def live_join_stream(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("click", "use"), ("view", "use"), ("purchase", "sale")], "k string, kind string")
    plan = lambda p: p.join(dim, "event_type", "k").group_by("kind", count("n"), sum_("value", "total"))
    return _rounded(_streamed(spark, d, plan), "total")


@_query(_pivot_sql("events", "event_type", "(user_id % 2)::VARCHAR", "value", ["0", "1"]))
def live_pivot_stream(spark: SparkSession, d: str) -> DataFrame:
    base = folder(spark)
    schema = Schema([Field("event_type", DataType.STRING), Field("side", DataType.STRING), Field("value", DataType.DOUBLE)])
    _load(spark, d, "events").select("event_type", (F.col("user_id") % 2).cast("string").alias("side"), "value").repartition(3).write.parquet(f"{base}/in")
    root = from_table(StreamedTable(spark, f"{base}/in", schema)).pivot("event_type", "side", "value", ["0", "1"]).root
    query = stream(root, lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/progress", available_now=True)
    query.awaitTermination()
    return _rounded(spark.read.parquet(f"{base}/out"), "0", "1")


@_query("SELECT n_name, n FROM nation JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) USING (n_regionkey)")
def cached_self_join(spark: SparkSession, d: str) -> DataFrame:
    """A source that a plan reads twice is read once (``test_one_read_of_a_shared_source`` counts)."""
    nation = BaseTable.of(_load(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r")))
    return pull_caching(from_table(nation).join(from_table(nation).group_by("r", count("n")).build(), "r", "r").project("n_name", "n").root).to_df()


# ---- order, empty input, tables built by rows, subscriptions


def _listed(spark: SparkSession, found: Slice, ddl: str) -> DataFrame:
    """The rows of a short read, numbered as they come."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found.rows())], f"place long, {ddl}")


def _in_order(spark: SparkSession, d: str, name: str, key: str) -> BaseTable:
    return BaseTable.of(_load(spark, d, name), order=[key])


@_query("""SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority QUALIFY place < 4""")
def group_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Groups come in the order in which their keys were first seen."""
    p = from_table(_in_order(spark, d, "orders", "o_orderkey")).group_by("o_orderpriority", count("n"))
    return _listed(spark, p.build().read(Viewport(limit=4)), "o_orderpriority string, n long")


@_query("SELECT 0::BIGINT AS n_groups, 0::BIGINT AS n_cells")
def group_of_nothing(spark: SparkSession, d: str) -> DataFrame:
    none = _plan(spark, d, "orders").filter(long_gt("o_orderkey", 1 << 60))
    groups = none.group_by("o_orderpriority", count("n"), sum_("o_totalprice", "total")).to_df()
    cells = none.pivot("o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"]).to_df()
    return groups.agg(F.count("*").alias("n_groups")).crossJoin(cells.agg(F.count("*").alias("n_cells")))


@_query("""SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 2 AS place, o_orderpriority,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS "P" FROM orders WHERE o_orderstatus IN ('P', 'O') GROUP BY o_orderpriority QUALIFY place BETWEEN 0 AND 2""")
def pivot_row_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a pivot come as their keys were first seen; a viewport cuts rows and columns of the result."""
    p = from_table(_in_order(spark, d, "orders", "o_orderkey")).pivot("o_orderpriority", "o_orderstatus", "o_totalprice", ["P", "O"])
    found = p.build().read(Viewport(rows=RowRange.of(1, 4), columns=("o_orderpriority", "P")))
    return _rounded(_listed(spark, found, "o_orderpriority string, `P` double"), "P")


_ODD = "CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN -0.0 WHEN 2 THEN 0.0 ELSE 1 + abs(value) END"


@_query(f"""SELECT 'up' AS way, row_number() OVER (ORDER BY {_ODD}, event_id) - 1 AS place, event_id FROM events QUALIFY place < 50
UNION ALL SELECT 'down', row_number() OVER (ORDER BY {_ODD} DESC, event_id) - 1 AS place, event_id FROM events QUALIFY place < 50""")
def sort_nan_and_zeros(spark: SparkSession, d: str) -> DataFrame:
    """NaN is the greatest value, -0.0 and 0.0 are equal, and equals stay as they were, both ways."""
    odd = F.when(F.expr("event_id % 5 = 0"), F.lit(float("nan"))).when(F.expr("event_id % 5 = 1"), F.lit(-0.0)).when(F.expr("event_id % 5 = 2"), F.lit(0.0))
    events = BaseTable.of(_load(spark, d, "events").select("event_id", odd.otherwise(1 + F.abs("value")).alias("value")), order=["event_id"])
    parts = []
    for way, ascending in (("up", True), ("down", False)):
        found = from_table(events).order_by("value", ascending=ascending).build().read(Viewport(columns=("event_id",), limit=50))
        parts.append(_listed(spark, found, "event_id long").withColumn("way", F.lit(way)))
    return parts[0].unionByName(parts[1])


@_query("SELECT true AS refused, count(*) AS n FROM events")
def sort_null_key(spark: SparkSession, d: str) -> DataFrame:
    """A null sort key is an error, unless ``nulls`` says where it goes."""
    events = BaseTable.of(_load(spark, d, "events").select("event_id", F.expr("nullif(event_id, 7)").alias("key")), order=["event_id"])
    try:
        from_table(events).order_by("key").build().read().rows()
        refused = False
    except Exception:  # Spark's own error, whose class depends on where it is raised
        refused = True
    n = from_table(events).order_by("key", nulls="last").to_df().agg(F.count("*").alias("n"))
    return n.withColumn("refused", F.lit(refused))


@_query("""SELECT 'live' AS made, r_regionkey, r_name FROM region UNION ALL SELECT 'live', 90, NULL UNION ALL SELECT 'live', 91, 'set'
UNION ALL SELECT 'built', r_regionkey, r_name FROM region""")
def tables_by_rows(spark: SparkSession, d: str) -> DataFrame:
    """A live table by ``append_row`` and ``RowAppender``, sealed in the end, and a sealed one by its builder."""
    schema = Schema([Field("r_regionkey", DataType.INT), Field("r_name", DataType.STRING)])
    live, built = BaseTable.create(spark, schema), BaseTable.builder(spark, schema)
    for r in _load(spark, d, "region").collect():  # five rows
        live.append_row(r.r_regionkey, r.r_name)
        built.append_row(r.r_regionkey, r.r_name)
    live.row().set_int("r_regionkey", 90).commit()
    live.row().set_int("r_regionkey", 91).set_string("r_name", "set").commit()
    live.seal()
    try:
        live.append_row(92, "late")
    except RuntimeError:
        pass
    made = [(name, t.read().to_df()) for name, t in (("live", live), ("built", built.build()))]
    return made[0][1].withColumn("made", F.lit("live")).unionByName(made[1][1].withColumn("made", F.lit("built")))


@_query("SELECT event_type, n, total FROM (SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type) WHERE n > 10")
def derived_as_source(spark: SparkSession, d: str) -> DataFrame:
    """A derived table is a source like any other."""
    grouped = _plan(spark, d, "events").group_by("event_type", count("n"), sum_("value", "total")).build()
    return _rounded(from_table(grouped).filter(long_gt("n", 10)).to_df(), "total")


@_query("""SELECT * FROM (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest([0, 1, 2, 2, 2]) AS version,
  unnest([0, count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type IN ('click', 'view')), 3, 0]) AS n,
  unnest([0, 1, 2, 2, 1]) AS n_groups FROM events) WHERE place < 4""")
def subscription_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """What subscriptions to a live table and to a table derived from it are given: at once, after appends and a new viewport, and never after close."""
    events, seen, groups = _load(spark, d, "events").select("event_id", "event_type"), [], []
    live = BaseTable.create(spark, Schema([Field("event_id", DataType.LONG), Field("event_type", DataType.STRING)]))
    derived = from_table(live).group_by("event_type", count("n")).build()
    with live.subscribe(Viewport(), lambda s: seen.append((s.version, s.row_count))) as own, derived.subscribe(Viewport(), lambda s: groups.append(s.row_count)) as other:
        live.append_frame(events.filter("event_type = 'click'"))
        live.append_frame(events.filter("event_type = 'view'"))
        own.update_viewport(Viewport.of_rows(0, 3))
        other.update_viewport(Viewport())
    live.append_frame(events.filter("event_type = 'error'"))
    return spark.createDataFrame([(i, v, n, g) for i, ((v, n), g) in enumerate(zip(seen, groups, strict=True))], "place int, version int, n long, n_groups int")


# ---- the flagship


@_query(_pivot_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", "o_orderpriority", "l_returnflag", "l_extendedprice * (1 - l_discount)", ["A", "N", "R"], "l_quantity > 10"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by order priority and return flag: filter, join, computed column, pivot."""
    p = _plan(spark, d, "lineitem").filter(double_gt("l_quantity", 10)).join(_plan(spark, d, "orders"), "l_orderkey", "o_orderkey")
    p = p.with_column("revenue", col("l_extendedprice") * (1 - col("l_discount"))).pivot("o_orderpriority", "l_returnflag", "revenue", ["A", "N", "R"])
    return _rounded(p.to_df(), "A", "N", "R")


@_query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def filter_group_sum(spark: SparkSession, d: str) -> DataFrame:
    p = _plan(spark, d, "lineitem").filter(double_gt("l_quantity", 25)).project("l_returnflag", "l_extendedprice")
    return _rounded(p.group_by("l_returnflag", count("n"), sum_("l_extendedprice", "total")).to_df(), "total")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


