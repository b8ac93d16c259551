"""Token counts by separator scan of flat, unindexed token files.

A token file is nothing but token ids, ``WIDTH`` bytes each (little endian), and
an end-of-document id behind every document.  ``scan`` finds the documents: files
are cut into blocks, wherever that falls; each block is searched for separators
at once with numpy and reports the documents that end in it, and what is left
over behind its last separator.  A prefix scan over the blocks' summaries (how
many separators, how many tokens are left over) then numbers the documents and
adds what earlier blocks left over to the first document that ends in a block.

``write_tokens`` makes such files from texts: Spark's text writer puts one
document's ids on a "line", and the separator ends it; so a lost or repeated
task leaves no partial file.  Ids are of a public byte-level BPE vocabulary, whose
path is a parameter (``VIEWLARK_BPE`` or the installed file of public tokenizers).

Null and empty texts are documents without tokens.  A file may lack the last
separator: what is behind its last one is a document, too (``closed`` false), if
there is any.  A byte that is left over at a file's end (no whole id) is an
error.  Empty files and folders give no rows.  Repeated rows are documents of
their own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, map_batches, materialise, shared_dir, table

WIDTH, SEPARATOR, BLOCK_BYTES = 2, 50256, 4 << 20
_encoders: dict = {}


def vocabulary_path() -> str:
    found = os.environ.get("VIEWLARK_BPE")
    if not found:
        import public_tokenizers

        found = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return found


def encoder(path: str):  # noqa: ANN201
    """The vocabulary, read once in each Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("viewlark", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the texts of ``docs`` as token files in the folder ``path``."""
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            ids = [np.asarray(own.encode_ordinary(t or ""), f"<u{WIDTH}").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    # the writer takes strings as they are, byte for byte; Latin-1 makes bytes of the separator
    lines = map_batches(docs.select("text"), encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
    separator = SEPARATOR.to_bytes(WIDTH, "little").decode("latin-1")
    lines.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _read(uri: str, offset: int, length: int) -> bytes:
    store, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, offset, length`` of all blocks of the files in ``path``; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    whole = block_bytes - block_bytes % WIDTH
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / whole)))
    return files.select("file", "length", at.alias("block")).select(
        "file", "block", (F.col("block") * whole).alias("offset"), F.least(F.lit(whole), F.col("length") - F.col("block") * whole).alias("length")
    )


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, document, start, tokens, closed``: every document of every file, numbered from 0 in its file."""
    places = blocks(spark, path, block_bytes)
    every = places.repartition(max(1, min(4096, places.count())))  # one block at a time in a task

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                raw = _read(file, offset, length)
                if len(raw) % width:
                    raise ValueError(f"{file}: its size is no multiple of {width} bytes")
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator)
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
                row = [[file], [block], [offset // width], [starts], [ends - starts], [len(raw) // width - (ends[-1] + 1 if len(ends) else 0)]]
                types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["file", "block", "first", "starts", "lengths", "rest"])

    schema = "file string, block long, first long, starts array<long>, lengths array<long>, rest long"
    found = materialise(map_batches(every, search, schema), "blocks")
    # the scan: a block's carry is what was left over since the last block with a separator
    n = F.size("lengths").cast("long")
    summary = found.select("file", "block", "first", n.alias("n"), "rest")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rest of the block with the last separator, and all of the blocks behind it
    stitched = (
        summary.withColumn("run", run)
        .withColumn("document", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("left", F.sum("rest").over(Window.partitionBy("file", "run").orderBy("block")))
        .withColumn("carry", F.coalesce(F.lag("left").over(order), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    docs = found.select("file", "block", "starts", "lengths").join(stitched, ["file", "block"])
    docs = docs.select("*", F.posexplode(F.arrays_zip("starts", "lengths")).alias("k", "d"))
    carried = F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    closed = docs.select(
        "file", (F.col("document") + F.col("k")).alias("document"), (F.col("first") + F.col("d.starts") - carried).alias("start"),
        (F.col("d.lengths") + carried).alias("tokens"), F.lit(True).alias("closed"),
    )
    last_end = F.col("first") + F.coalesce(F.element_at("starts", -1) + F.element_at("lengths", -1) + 1, F.lit(0)) + F.col("rest")
    size = found.groupBy("file").agg(F.max(F.when(F.size("lengths") > 0, last_end).otherwise(F.col("first") + F.col("rest"))).alias("size"))
    opened = (
        stitched.filter(F.col("last") & (F.col("left") > 0)).join(size, "file")
        .select("file", (F.col("document") + F.col("n")).alias("document"), (F.col("size") - F.col("left")).alias("start"), F.col("left").alias("tokens"), F.lit(False).alias("closed"))
    )
    return closed.unionByName(opened)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise all documents to flat files in the shared folder and count by scanning these."""
    path = f"{shared_dir(spark)}/viewlark-ids-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    found = scan(spark, path)  # it has read the files by now
    delete(spark, path)
    return found.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))


ORACLE_SQL = None
