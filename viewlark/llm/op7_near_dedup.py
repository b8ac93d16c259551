"""Near-duplicate detection with min-max hashing.

A text's set are its distinct shingles of ``shingle`` words (its whole sequence
if it has fewer words).  Each hash function gives two values of a signature, the
least and the greatest over the set, which halves the evaluations.  Signatures
are cut into bands of ``ROWS`` values, as many as leave a pair of exactly the
asked similarity unseen with a chance of one in a million.  What shares a band
is compared, and a link counts only when confirmed on the full sets.

1. Texts of equal sets are one *set* from here on, named by its least doc_id.
2. Each set is paired with one set of its buckets: of these buckets' least
   members the one whose signature is nearest, confirmed on the full sets.
3. Components of these links.  A bucket whose members are all in one component
   is settled; of the others every pair of members from different components
   is looked at, in its first common band, by signature; what might be a link
   is confirmed on the full sets (unless the task has joined the two already).
4. Components of all links; each text gets its set's.

What is lost is what no band shows, and what the signatures' estimate misses by
more than ``MARGIN`` (over four of its standard deviations): each has a chance of a
few in a million for a pair at exactly the asked similarity, less for nearer ones
(tests measure it).  No list of all pairs is made: a
task emits at most a forest of its members, and a group of n copies costs n
rows.  Large buckets are cut into blocks, and pairs of blocks are tasks, of at
most some ten thousand shingles each way; equal sets (which may be a third of
all rows) are joined by a lookup that treats such keys apart.

Words are runs of other than white space; A-Z are lower-cased, nothing else is.
Null, empty and blank texts have an empty set and are linked with nothing.  A
row with a null doc_id is linked with nothing, has no component, and is kept.
A doc_id names one text: of rows that repeat it each gets its row, and if their
texts differ, links are confirmed on one of these; ``dedup`` keeps one of the rows
that have the text in common, too.  Empty tables give no rows.  Extra columns are ignored (``dedup``
keeps them).  Shingles stand for their words as hashes of 64 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lookup, map_batches, materialise, select_by_id, table
from .op2_language_id import flat_bytes

ROWS, MISS, MARGIN = 6, 1e-6, 0.13
BLOCK, BLOCK_SHINGLES, CHUNK = 1024, 4_000_000, 1 << 16

U = np.uint64
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


@lru_cache
def functions_of(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    n = -(-values // 2)
    a = rng.integers(0, 2**63, n, dtype=np.int64).astype(U) * U(2) + U(1)
    return a, rng.integers(0, 2**63, n, dtype=np.int64).astype(U)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words end."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    x = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inner = ~((x == 32) | ((x >= 9) & (x <= 13)))
    before = np.empty(len(x), bool)
    before[0], before[1:] = False, inner[:-1]
    before[ends[:-1][ends[:-1] < len(x)]] = False  # a text's first byte starts a word
    starts = np.flatnonzero(inner & ~before)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    word = np.cumsum(inner & ~before) - 1
    place = np.arange(len(x)) - starts[np.maximum(word, 0)]
    powers = np.multiply.accumulate(np.full(int(place[inner].max()) + 1, _BASE))
    values = np.where(inner, _BYTES[x] * powers[np.where(inner, place, 0)], U(0))
    return mix(np.add.reduceat(values, starts)), np.searchsorted(starts, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Of each text, its distinct shingles' hashes, in order."""
    words, at = word_hashes(data, ends)
    n = len(words) - shingle + 1
    h = np.zeros(max(0, n), U)
    for k in range(shingle):
        if n > 0:
            h = (h + words[k : k + n]) * U(0xD6E8FEB86659FD93 + 2 * k)
    h = mix(h)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= shingle:
            out.append(np.unique(h[a : b - shingle + 1]))
        elif b > a:
            few = U(b - a)
            for w in words[a:b]:
                few = mix(np.array([few]) * U(0xA24BAED4963EE407) + w)[0]
            out.append(np.array([few], U))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """Least values under each function, then the greatest; rows of empty sets are zeros."""
    a, b = functions_of(values)
    out = np.zeros((len(sets), 2 * len(a)), U)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        size, to = 0, at
        while to < len(full) and (to == at or size + len(sets[full[to]]) <= CHUNK):
            size += len(sets[full[to]])
            to += 1
        some = full[at:to]
        x = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        for j in range(len(a)):
            y = x * a[j] + b[j]
            y ^= y >> U(32)  # so that the low bits count in the order of equals, too
            out[some, j] = np.minimum.reduceat(y, starts)
            out[some, len(a) + j] = np.maximum.reduceat(y, starts)
        at = to
    return out[:, :values]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, ROWS)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]) * _BASE
    for k in range(ROWS):
        h = mix(h ^ parts[:, :, k]) + _BASE
    return h.view(np.int64)


def _batches(data: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of some MB of text."""
    flat, ends = flat_bytes(data)
    i = 0
    while i < len(ends) - 1:
        j = min(len(ends) - 1, max(i + 1, int(np.searchsorted(ends, ends[i] + limit))))
        yield i, j, flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def sketches(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """``doc_id, n_shingles, key, bands, sig`` of every row: set's size, its name, band keys, low bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, ends in _batches(b.column(1)):
                sets = shingle_sets(data, ends, shingle)
                sig = signatures(sets, bands * ROWS)
                n = [len(s) for s in sets]
                key = [np.array([m, mix(s).sum(dtype=U), mix(s ^ _BASE).sum(dtype=U)], U).tobytes() if m else None for m, s in zip(n, sets)]
                keys = pa.array([x if m else None for m, x in zip(n, band_keys(sig, bands))], pa.list_(pa.int64()))
                low = pa.array([bytes(x) for x in sig.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(key, pa.binary()), keys, low],
                    ["doc_id", "n_shingles", "key", "bands", "sig"],
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, bands array<long>, sig binary")


def _sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id, set`` of the documents in ``ids`` (column id)."""
    wanted = select_by_id(docs.select("doc_id", "text"), ids, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, ends in _batches(b.column(1)):
                sets = pa.array([s.tobytes() for s in shingle_sets(data, ends, shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), sets], ["id", "set"])

    return map_batches(wanted, run, "id long, set binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 times the shared at least ``percent`` times the union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of equal first ``keys`` columns, which come one behind the other, as columns."""
    held: list[list] = []
    for b in batches:
        if not len(b):
            continue
        cols = [c.to_pylist() for c in b.columns]
        cuts = [0]
        change = np.zeros(len(b), bool)
        for c in cols[:keys]:
            v = np.array(c, np.int64)
            change[1:] |= v[1:] != v[:-1]
        cuts += [*np.flatnonzero(change).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:]):
            part = [c[x:y] for c in cols]
            if held and all(held[k][0] == part[k][0] for k in range(keys)):
                for h, p in zip(held, part):
                    h.extend(p)
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def _similar(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Share of equal values in every pair of signatures."""
    out = np.zeros((len(sig_a), len(sig_b)), np.float32)
    for k in range(sig_a.shape[1]):
        out += sig_a[:, k, None] == sig_b[None, :, k]
    return out / sig_a.shape[1]


def _pairs(col: list[list], near: float, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In a pair of blocks, the pairs of different components that might be links and meet here first."""
    _, bi, bj, block, _, comp, keys, sig = col[:8]
    block, comp = np.array(block), np.array(comp)
    keys = np.array(keys, np.int64)
    sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(comp), -1)
    left, right = np.flatnonzero(block == bi[0]), np.flatnonzero(block == bj[0])
    ok = comp[left][:, None] != comp[right][None]
    if bi[0] == bj[0]:
        ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None]
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    for k in range(bands):
        if (keys[:, k] == col[0][0]).all():  # this bucket's band
            break
        ok &= keys[left, k][:, None] != keys[right, k][None]
    x, y = np.nonzero(ok)
    if len(x) * 8 > len(left) * len(right):
        s = _similar(sig[left], sig[right])[x, y]
    else:
        s = np.concatenate([(sig[left[x[i : i + 4096]]] == sig[right[y[i : i + 4096]]]).mean(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0)])
    good = s >= near
    return left[x[good]], right[y[good]], s[good]


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles every pair of ``left`` and ``right`` shares, as a matrix."""
    owner = np.concatenate([np.full(len(sets[i]), k) for k, i in enumerate([*left, *right])])
    values, at, count = np.unique(np.concatenate([sets[i] for i in [*left, *right]]), return_inverse=True, return_counts=True)
    keep = count[at] > 1  # what one set alone has is shared with none
    owner, at = owner[keep], np.unique(at[keep], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = 4096
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        x, y = np.searchsorted(at, [a, a + step])
        m = np.zeros((len(left) + len(right), step), np.float32)
        m[owner[x:y], at[x:y] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the least id that each id of ``links`` (a, b) reaches."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(both, "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    labels_before = labels
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        # the label of the label, too: chains of links halve each time
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        moved = lower.join(jump, "to").select("id", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") < F.col("label")).alias("moved"))
        moved = materialise(moved, "labels")
        discard(labels_before)
        labels, labels_before = moved.select("id", "label"), moved
        if moved.filter("moved").isEmpty():
            discard(edges)
            return labels


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    similarity = percent / 100
    bands, near = bands_for(similarity), similarity - MARGIN
    sk = materialise(sketches(docs, shingle, bands), "sketches")
    usable = sk.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    reps = materialise(
        usable.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")),
        "sets",
    )
    members = reps.select(F.col("id"), "n", F.explode("bands").alias("bucket"))
    buckets = materialise(
        members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("id").alias("center")).filter("size > 1"),
        "buckets",
    )
    inside = materialise(members.drop("n").join(buckets, "bucket"), "members")

    # one partner for each set: of its buckets' least members the nearest by signature
    offers = inside.filter("id <> center").select("id", F.col("center").alias("other")).distinct()
    sigs = reps.select("id", "sig")
    offers = offers.join(sigs, "id").join(sigs.select(F.col("id").alias("other"), F.col("sig").alias("other_sig")), "other")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(len(b), -1) for k in (2, 3))
                s = (x == y).mean(axis=1)
                keep = pa.array(s >= near)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(s).filter(keep)], ["id", "other", "s"])

    likely = map_batches(offers.select("id", "other", "sig", "other_sig"), estimate, "id long, other long, s double")
    best = likely.groupBy("id").agg(F.max(F.struct("s", (-F.col("other")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("other"))
    first = materialise(best, "partners")
    asked = first.select("id").unionByName(first.select(F.col("other").alias("id"))).distinct()
    asked = materialise(asked, "asked")
    sets = materialise(_one_set(_sets_of(docs, asked, shingle)), "shingles")
    found = materialise(_confirm(first, sets, percent), "links")

    # what different components of a bucket may still have in common
    label = components(found)
    placed = inside.join(label, "id", "left").select("bucket", "id", "size", "shingles", F.coalesce("label", "id").alias("comp"))
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rest = placed.join(open_, "bucket").withColumn("blocks", blocks)
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.join(reps.select("id", "bands", "sig"), "id")
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["bucket", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", "id", "comp", "bands", "sig"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _groups(batches, 3):
            x, y, _ = _pairs(col, near, bands)
            some = np.unique(np.concatenate([x, y]))
            if len(some):
                ids = [[c[i] for i in some] for c in col[:8]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(ids, types)], names)

    names = ["bucket", "bi", "bj", "block", "id", "comp", "bands", "sig"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    schema = "bucket long, bi int, bj int, block int, id long, comp long, bands array<long>, sig binary"
    together = lambda df: df.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    chosen = materialise(map_batches(together(rest.select(*columns)), choose, schema), "chosen")
    more = materialise(chosen.select("id").distinct().join(sets.select("id"), "id", "left_anti"), "asked")
    more_sets = materialise(_one_set(_sets_of(docs, more, shingle)), "shingles")
    all_sets = sets.unionByName(more_sets)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _groups(batches, 3):
            x, y, s = _pairs(col, near, bands)
            sets_ = [np.frombuffer(v, U) for v in col[8]]
            out = _forest(col[4], col[5], sets_, x, y, s, percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    late = materialise(map_batches(together(chosen.join(all_sets, "id").select(*names, "set")), confirm, "a long, b long"), "links")
    label = components(found.unionByName(late))
    discard(buckets, inside, first, asked, sets, found, chosen, more, more_sets, late)
    of_key = reps.select("key", "id").join(label, "id", "left").select("key", F.coalesce("label", "id").alias("component"))
    rows = sk.select("doc_id", "n_shingles", "key")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return lookup(rows, of_key, "key").select("doc_id", "n_shingles", own.alias("component_id"))


def _one_set(sets: DataFrame) -> DataFrame:
    """One row an id, also where rows repeat a doc_id."""
    return sets.groupBy("id").agg(F.max("set").alias("set"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` (id, other) that are links; a set that many are paired with is not copied to each of them."""
    at = pairs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))  # of one hub, up to 64 tasks
    own = at.join(sets, "id").select("other", "part", F.lit(1).alias("kind"), "id", "set")
    hubs = at.select("other", "part").distinct().join(sets.select(F.col("id").alias("other"), "set"), "other")
    hubs = hubs.select("other", "part", F.lit(0).alias("kind"), F.col("other").alias("id"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, key = None, None
        for b in batches:
            out = []
            for other, part, kind, i, s in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(s, U)
                if kind == 0:
                    hub, key = s, (other, part)
                elif key == (other, part) and linked(hub, s, percent):
                    out.append((i, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    together = own.unionByName(hubs).repartition("other", "part").sortWithinPartitions("other", "part", "kind")
    return map_batches(together, run, "a long, b long")


def _forest(ids: list[int], comp: list[int], sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, s: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components, likeliest pairs first; pairs that are joined by then are passed over."""
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, shared = [], None
    if len(x) > 2000:
        left, right = np.unique(x), np.unique(y)
        shared, lx, ry = _shared(sets, left, right), np.searchsorted(left, x), np.searchsorted(right, y)
        size = np.array([len(v) for v in sets])
        both = shared[lx, ry].astype(np.int64)
        good = 100 * both >= percent * (size[x] + size[y] - both)
        x, y, s = x[good], y[good], s[good]
    for k in np.argsort(-s, kind="stable"):
        a, b = find(comp[x[k]]), find(comp[y[k]])
        if a != b and (shared is not None or linked(sets[x[k]], sets[y[k]], percent)):
            root[max(a, b)] = min(a, b)
            out.append((ids[x[k]], ids[y[k]]))
    return out


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, with all columns: of each component the document of the least doc_id, each of its texts once."""
    found = classes(docs, shingle, percent)
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")), "gone")
    kept = select_by_id(docs, gone, "left_anti")
    again = materialise(docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id"), "again")
    if again.isEmpty():
        return kept
    place = f"place_{uuid.uuid4().hex}"  # no column of docs
    order = Window.partitionBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("text", *(F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")))
    once = select_by_id(kept, again, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return select_by_id(kept, again, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), 3, 85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: All pairs with a shingle in common; components by spreading the least id.
ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM cut
), sets AS MATERIALIZED (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM shingled WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s
), spread AS MATERIALIZED (
  SELECT id, n, unnest(s) AS x FROM sets
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM spread a JOIN spread b ON a.x = b.x AND a.id < b.id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id, id AS label FROM sets UNION SELECT edges.b, label FROM reach JOIN edges ON edges.a = reach.id
), label AS (
  SELECT s, min(label) AS component FROM reach JOIN sets USING (id) GROUP BY s
)
SELECT doc_id, len(shingled.s)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id,
  coalesce(doc_id = component_id, true) AS kept
FROM shingled LEFT JOIN label ON shingled.s = label.s
"""
