"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes of a text has an entropy; its rarity is the
corpus's share of windows with that entropy (counted over all texts, in
``LEVELS`` steps), so flat and ordinary windows rank low and unusual ones high.
A window that is the rarest (the leftmost of equals) in ``LEAST`` or more of the
``NEIGHBOURS`` stretches that hold it is a feature; a stretch is ``NEIGHBOURS``
windows in a row, or what of these the text has.  Features are hashed into Bloom
filters of ``BITS`` bits, ``PER_FILTER`` to a filter, one filter after another;
the chain of filters is the fingerprint.

Two fingerprints are compared filter by filter: the overlap of bits, less what
chance gives, over the most it could be; each filter of the shorter chain takes
its best partner, and the mean, weighted with the filters' bits, is the
likeness, from 0 to 1.

Null texts are empty.  The rule is one for all lengths: the rarest window of a
text is in every stretch that could hold it, so a text of a window or more has a
feature; a text that is shorter is its own only feature, and an empty one has none
and the empty fingerprint.  Equal texts have equal fingerprints, and likeness 1;
an empty and another text have likeness 0.  In ``with_next`` the rows follow one
another by descending doc_id, rows of equal ids by their text, and null ids come
last.  Empty tables give no rows; extra columns are ignored.

Scale: the corpus pass returns one histogram.  The next document is found by
dealing the texts once, by ranges of doc_id, one range a task, and reading each range
in order; the first row of every range goes to the range before as well.  There are
up to ``RANGES`` ranges; beyond that they grow, and a range is sorted on disk.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .op2_language_id import flat_bytes

WINDOW, LEVELS, NEIGHBOURS, LEAST = 32, 1000, 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
ROWS_PER_RANGE, RANGES, CHUNK_BYTES = 4000, 1 << 14, 1 << 19

# c log c in whole parts of 2^-24, so that a window's sum is exact wherever it stands
_G = np.rint(np.arange(WINDOW + 2) * np.log2(np.maximum(1, np.arange(WINDOW + 2))) * (1 << 24)).astype(np.int64)
_UP = _G[1:] - _G[:-1]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """The entropy, in steps, of the window that starts at each byte of ``x``; windows run over texts' ends."""
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 63 before and behind
    for k in range(1, WINDOW):
        same = (x[k:] == x[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    # the sum of c log c over a window's byte counts c changes by what comes and what goes
    change = _UP[before]
    change[WINDOW:] -= _UP[after[:-WINDOW]]
    sums = np.cumsum(change)[WINDOW - 1 :]
    entropy = np.log2(WINDOW) - sums / (WINDOW << 24)
    return np.clip(np.rint(entropy * (LEVELS - 1) / np.log2(WINDOW)), 0, LEVELS - 1).astype(np.int32)


def chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about CHUNK_BYTES."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_BYTES)))
        yield i, min(j, len(ends) - 1)
        i = j


def whole(ends: np.ndarray, n: int) -> np.ndarray:
    """True where the window starting there lies in one text."""
    out = np.zeros(n, bool)
    for a, b in zip(ends[:-1], ends[1:]):
        out[a : max(a, b - WINDOW + 1)] = True
    return out


def count_levels(docs: DataFrame) -> np.ndarray:
    """Of the windows of all texts, how many have which entropy."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            data, ends = flat_bytes(b.column(0))
            for i, j in chunks(ends):
                own, e = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                if len(own) >= WINDOW:
                    levels = entropy_levels(own)
                    total += np.bincount(levels[whole(e, len(levels))], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(total)], ["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in map_batches(docs.select("text"), count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r.level] = r.n
    return out


def ranks(levels: np.ndarray) -> np.ndarray:
    """0 for the rarest entropy.  Flat windows (runs, rules, padding) say little: those come last."""
    order = np.lexsort((np.arange(LEVELS), levels))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    out[: LEVELS // 10] += LEVELS
    return out


def features(data: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Of each text, the hashes of its features, in their order."""
    out: list[np.ndarray] = []
    for i, j in chunks(ends):
        own, e = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        out += _features(own, e, rank)
    return out


def _features(x: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    starts, sizes = ends[:-1], np.diff(ends)
    out = [np.frombuffer(hashlib.blake2b(x[a : a + n].tobytes(), digest_size=8).digest(), np.uint64) if 0 < n < WINDOW else np.zeros(0, np.uint64) for a, n in zip(starts, sizes)]
    if len(x) < WINDOW:
        return out
    levels = entropy_levels(x)
    at = np.flatnonzero(whole(ends, len(levels)))
    if not len(at):
        return out
    doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - WINDOW + 1))
    # texts are set apart, so that no stretch has windows of two
    none = np.iinfo(np.int64).max
    low = np.full(len(x) + (len(sizes) + 2) * NEIGHBOURS, none)
    low[at + (doc + 1) * NEIGHBOURS] = rank[levels[at]] * (1 << 40) + at
    for k in (1, 2, 4, 8, 16, 32):  # NEIGHBOURS is their sum and one
        low = np.minimum(low[: len(low) - k], low[k:])
    chosen = np.flatnonzero(np.bincount(low[low < none] & ((1 << 40) - 1), minlength=len(x)) >= LEAST)
    hashes, cut = _hash(x, chosen, WINDOW), np.searchsorted(chosen, ends)
    return [hashes[cut[i] : cut[i + 1]] if sizes[i] >= WINDOW else out[i] for i in range(len(sizes))]


def _hash(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = (x[at[:, None] + np.arange(n)].astype(np.uint64) * _POWERS[:n]).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def digest(hashes: np.ndarray) -> bytes:
    """The chain of Bloom filters."""
    if not len(hashes):
        return b""
    step = hashes | np.uint64(1)
    turned = (hashes >> np.uint64(32)) | (hashes << np.uint64(32))
    bits = (turned[:, None] + np.arange(HASHES, dtype=np.uint64) * (step >> np.uint64(11))[:, None]) % np.uint64(BITS)
    chain = np.zeros((-(-len(hashes) // PER_FILTER), BITS), np.uint8)
    chain[np.repeat(np.arange(len(hashes)) // PER_FILTER, HASHES), bits.reshape(-1).astype(np.int64)] = 1
    return np.packbits(chain, axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    best = np.zeros(len(x))
    for i in range(0, len(y), 256):
        both, most = x @ y[i : i + 256].T, np.minimum(nx[:, None], ny[None, i : i + 256])
        chance = nx[:, None] * ny[None, i : i + 256] / BITS
        part = np.where(most > chance, (both - chance) / np.maximum(1e-6, most - chance), both >= most)
        best = np.maximum(best, np.clip(part, 0, 1).max(axis=1))
    return float(np.clip((best * nx).sum() / nx.sum(), 0, 1))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return flat_bytes(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))


def _with_next(rank: np.ndarray) -> Callable:
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    code = lambda d: base64.b64encode(d).decode()

    def prints(texts: list[str]) -> list[bytes]:
        data, ends = _pack(texts)
        return [digest(h) for h in features(data, ends, rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next is not here yet: part, doc_id, text, lookahead, fingerprint

        def rows(new: list[tuple]) -> Iterator[tuple]:
            nonlocal held
            own = [(*r, p) for r, p in zip(new, prints([r[2] for r in new]))]
            seq, held = held + own, own[-1:]
            pairs = [(a, b) for a, b in zip(seq, seq[1:]) if a[0] == b[0] and not a[3]]
            texts = [_edited(a[2], b[2]) for a, b in pairs]
            for (a, b), t, p in zip(pairs, texts, prints(texts)):
                sha = hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()
                yield a[1], len(a[2]), sha, code(a[4]), code(p), likeness(a[4], p), likeness(a[4], b[4])

        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            at, size = 0, 0
            for k, v in enumerate(values):  # a few MB of texts at a time
                size += len(v[2])
                if size > 2_000_000 or k == len(values) - 1:
                    out = list(rows(values[at : k + 1]))
                    at, size = k + 1, 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], fields)

    return run


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Which of the ranges between the falling ``bounds`` an id is in; null ids are in the last."""
    last = F.lit(len(bounds)).cast("int")
    if not bounds:
        return last
    some = math.isqrt(len(bounds)) + 1  # first among every so many bounds, and then between two of these
    groups = [bounds[i : i + some] for i in range(0, len(bounds), some)]
    heads, tails = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>"), F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    group = F.size(F.filter(heads, lambda b: b >= doc_id))
    within = F.size(F.filter(F.get(tails, group - 1), lambda b: b >= doc_id))
    return F.when(doc_id.isNull(), last).when(group == 0, F.lit(0)).otherwise((group - 1) * some + within).cast("int")


def with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Fingerprints of every text, its edited text and its next document's, and how near they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids, spark = docs.select("doc_id"), docs.sparkSession
    parts = max(1, min(RANGES, ids.count() // ROWS_PER_RANGE))
    # bounds from a sketch of the ids; any bounds give the same rows
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}, reverse=True) if parts > 1 else []
    part = _range_of(F.col("doc_id"), bounds)
    firsts = sorted(
        ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("first")).collect(), key=lambda r: r.part
    )  # one row a range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    # the range that looks ahead to a first row; the first: the last
    looks = spark.createDataFrame([(r.first, firsts[i - 1].part) for i, r in enumerate(firsts)], "first long, part int")
    # of several rows with the first id, the one with the least text comes first
    ahead = rows.join(F.broadcast(looks), rows["doc_id"].eqNullSafe(looks["first"])).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    dealt = (
        rows.select(part.alias("part"), "doc_id", "text", F.lit(False).alias("ahead"))
        .unionByName(ahead.select("part", "doc_id", "text", F.lit(True).alias("ahead")))
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")
        .select("part", "doc_id", "text", "ahead")
    )
    return map_batches(dealt, _with_next(rank), _SCHEMA)


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, ranks(count_levels(docs)))


ORACLE_SQL = None
