"""Live tables as streams: each micro-batch is a version.

The batches of a live table are Parquet files in a folder.  ``stream`` follows
the folder and, after each micro-batch, gives the plan's result over everything
that has come so far: groups and pivots are kept by Spark as streaming state
(complete mode), so a batch costs what is new, not what there is; a plan of rows
only (filters, joins with sealed tables) gives each batch's own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import POS, Aggregate, Operator, OrderBy, Pivot
from ..operators.core import Context, backquoted
from ..schema import Schema
from ..tables import BaseTable, Table
from ..viewport import ALL, RowRange, Viewport


class StreamedTable(Table):
    """A table whose rows arrive as Parquet files in ``path``; a source for plans that are streamed."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema, files_per_batch: int | None = None):
        self.spark, self.path, self.schema = spark, path, schema
        reader = spark.readStream.schema(schema.to_spark())
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        pos = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        self._frame = reader.parquet(path).select(*backquoted(schema.names), pos.alias(POS))

    def append(self, df: DataFrame) -> None:
        """Rows of ``df`` as new files."""
        df.select(*backquoted(self.schema.names)).write.mode("append").parquet(self.path)

    @property
    def version(self) -> int:
        return 0

    @property
    def size(self) -> int:
        return self.spark.read.schema(self.schema.to_spark()).parquet(self.path).count()

    def base_tables(self) -> list[Table]:
        return [self]

    def frame(self) -> DataFrame:
        return self._frame

    def read(self, viewport: Viewport = ALL):  # noqa: ANN201
        """What has arrived by now, as a batch read."""
        from ..sources import parquet

        return parquet.read(self.spark, self.path).read(viewport)

    def subscribe(self, viewport, on_change):  # noqa: ANN001, ANN201
        raise NotImplementedError("use stream()")


def keeps_state(root: Operator) -> bool:
    return isinstance(root, (Aggregate, Pivot)) or any(map(keeps_state, root.inputs()))


class _Streaming(Context):
    def read(self, table: Table, rows: RowRange) -> DataFrame:
        if not rows.is_all:
            raise ValueError("a stream has no row range")
        # a stream's results have no order, and the order of a sealed table may be one that streams refuse
        return table.unordered().withColumn(POS, F.lit(0)) if isinstance(table, BaseTable) else table.frame()


def stream(
    root: Operator, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, period: str | None = None,
) -> StreamingQuery:
    """Run ``root`` over its streamed tables; ``on_batch(result, version)`` gets each batch's result.

    The result is the whole table for plans with a group or a pivot, and the new
    rows for others.  ``checkpoint`` is the folder of the stream's progress and
    state: a restart with it goes on where it stopped, and a batch that is run
    again has the same number.
    """
    while isinstance(root, OrderBy):  # the consumer sorts what it gets
        root = root.up
    df = root.frame(_Streaming())
    stateful = keeps_state(root)
    out = df.select(*backquoted(root.schema.names))
    writer = out.writeStream.outputMode("complete" if stateful else "append").option("checkpointLocation", checkpoint)
    writer = writer.queryName(f"viewlark-{uuid.uuid4().hex[:8]}").foreachBatch(on_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif period:
        writer = writer.trigger(processingTime=period)
    return writer.start()


