"""A demonstration source: a wide book of trades, one column of sensitivities for each tenor.

The shock of a tick is a function of the row, the tenor and the tick, so that a
version is a plan over the one before it, and every read of it gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import POS, Context
from ..schema import DataType, Field, Schema
from ..shared import folder
from ..tables import Slice, Subscription, Table, _Fixed, finish
from ..viewport import ALL, Viewport

#: Fixed values of the demonstration.
BOOKS, SPREAD, SHOCK = 10, 25_000.0, 400.0
KEPT_TICKS = 8


class WideBookTable(Table):
    def __init__(self, spark: SparkSession, buckets: list[str], trades: int, seed: int = 42, prefix: str = "T"):
        if not buckets or trades < 1 or not prefix:
            raise ValueError("a book needs buckets, trades and a prefix")
        self.spark, self.buckets, self.trades, self._seed = spark, list(buckets), trades, seed
        self.schema = Schema([Field("trades", DataType.STRING), Field("book", DataType.STRING), *(Field(b, DataType.DOUBLE) for b in buckets)])
        self.aggregate_schema = Schema([Field("book", DataType.STRING), *(Field(b, DataType.DOUBLE) for b in buckets)])
        self._prefix, self._ticks, self._listeners = prefix, [], []
        self._base: tuple[int, str] | None = None

    @property
    def version(self) -> int:
        return len(self._ticks)

    @property
    def size(self) -> int:
        return self.trades

    def base_tables(self) -> list[Table]:
        return [self]

    def _uniform(self, bucket: int, salt: int) -> F.Column:
        """A number from 0 (excluded) to 1 that depends on the trade, the bucket and the salt."""
        h = F.xxhash64(F.col("id"), F.lit(bucket), F.lit(self._seed), F.lit(salt))
        return (F.pmod(h, F.lit(1 << 52)) + 1).cast("double") / float((1 << 52) + 1)

    def frame(self) -> DataFrame:
        cells, done = [], self._base[0] if self._base else 0
        for k, name in enumerate(self.buckets):
            value = F.col(f"`{name}`") if self._base else (self._uniform(k, 0) * 2 - 1) * SPREAD
            for i in range(done, len(self._ticks)):  # a normal draw, by Box and Muller
                a, b = self._uniform(k, 2 * i + 1), self._uniform(k, 2 * i + 2)
                value = value + F.sqrt(F.log(a) * -2.0) * F.cos(b * 6.283185307179586) * SHOCK
            cells.append(value.alias(name))
        book = F.concat(F.lit("BOOK_"), (F.col("id") % BOOKS).cast("string"))
        if self._base:
            rows = self.spark.read.parquet(self._base[1]).withColumnRenamed(POS, "id")
            return rows.select("trades", "book", *cells, F.col("id").alias(POS))
        return self.spark.range(self.trades).select(F.concat(F.lit(self._prefix), F.col("id").cast("string")).alias("trades"), book.alias("book"), *cells, F.col("id").alias(POS))

    def apply_global_tick(self) -> None:
        """Shock every cell: a new version.  Every ``KEPT_TICKS`` a version is written, so that plans stay short."""
        self._ticks.append(len(self._ticks))
        if len(self._ticks) % KEPT_TICKS == 0:
            path = folder(self.spark)
            self.frame().write.parquet(path)
            self._base = (len(self._ticks), path)
        for listener in list(self._listeners):
            listener(self.version)

    def read(self, viewport: Viewport = ALL) -> Slice:
        return finish(Context().read(_Fixed(self.frame()), viewport.rows), self.schema, viewport, self.version)

    def aggregated(self) -> DataFrame:
        sums = [F.sum(F.col(f"`{b}`")).alias(b) for b in self.buckets]
        return self.frame().groupBy("book").agg(*sums, F.min(POS).alias(POS))

    def read_aggregated_by_book(self, viewport: Viewport = ALL) -> Slice:
        """One row a book, with the sums of its trades."""
        return finish(Context().read(_Fixed(self.aggregated()), viewport.rows), self.aggregate_schema, viewport, self.version)

    def add_listener(self, listener: Callable[[int], None]) -> None:
        self._listeners.append(listener)

    def remove_listener(self, listener: Callable[[int], None]) -> None:
        self._listeners = [x for x in self._listeners if x is not listener]

    def subscribe(self, viewport: Viewport, on_change: Callable[[Slice], None]) -> Subscription:
        listener = lambda _: held.deliver()
        held = Subscription(self, viewport, on_change, lambda: self.remove_listener(listener))
        self.add_listener(listener)
        held.deliver()
        return held
