"""Helpers that several operators share: reading, shared storage, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own, which only a local session can share.

    ``viewlark.shared`` does the same for the rest of the library, which this subpackage must not be needed for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="viewlark-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/viewlark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._viewlark_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, when nothing that is yet to run reads it."""
    for df in written:
        delete(df.sparkSession, df._viewlark_path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of ours, in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def hot_keys(df: DataFrame, key: str, parts: int = 512) -> DataFrame:
    """Keys with more than one ``parts``-th of the rows: fewer than ``parts`` of them, whatever the input."""
    least = df.count() // parts
    return df.groupBy(key).count().filter(F.col("count") > least).select(key)


def lookup(big: DataFrame, unique: DataFrame, key: str, parts: int = 512) -> DataFrame:
    """Left join of ``big`` with ``unique`` (one row a key) that no hot key can stall.

    Rows of the hot keys, of which there are fewer than ``parts``, meet a
    broadcast of their few rows of ``unique``; the others meet it in a shuffle.
    """
    hot = hot_keys(big, key, parts)
    flagged = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = F.broadcast(unique.join(F.broadcast(hot), key, "left_semi"))
    of_hot = flagged.filter(F.col("_hot")).drop("_hot").join(few, key, "left")
    rest = flagged.filter(F.col("_hot").isNull()).drop("_hot").join(unique, key, "left")
    return of_hot.unionByName(rest)


#: Rows that a Python worker gets at a time: texts can be long, and a worker's memory must not depend on how many are.
BATCH_ROWS = 500


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with small batches, whatever the rows' size.

    The setting is read when the plan runs, so the session keeps the smaller batches.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    now = int(conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def others_than(docs: DataFrame, *names: str) -> tuple[list[str], list[str]]:
    """The other columns' names and their part of a schema; names are compared as Spark does."""
    own = [f for f in docs.schema if f.name.lower() not in names]
    return [f.name for f in own], [f"`{f.name}` {f.dataType.simpleString()}" for f in own]


#: So many ids are broadcast at most (some 10 to 20 MB); more are met in a shuffle.
BROADCAST_IDS = 1_000_000


def select_by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_semi``) or isn't (``left_anti``) in ``ids`` (column id, written before)."""
    own = f"id_{uuid.uuid4().hex}"  # no column of docs
    few = ids.select(F.col("id").alias(own)).distinct()
    side = F.broadcast(few) if ids.count() <= BROADCAST_IDS else few
    return docs.join(side, docs["doc_id"] == side[own], how)
