"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text's words (runs of letters, in lower case, cut at ``LONGEST``) are read in
windows of ``WINDOW`` words.  Each window is compressed with the ordinary and
with the toxic dictionary, and the difference of the lengths tells which of the
two it belongs to.  Every window of a text is compressed (equal ones once while they
are remembered), as two words can cost another difference than each alone.
A window is a hit from a threshold on that is calibrated on labelled texts the dictionaries have not seen.  A text's score is the probability,
from a logistic curve fitted on the same texts, given its number of hits, their
share, and its largest difference.

Both dictionaries start with what zstandard's trainer finds in ordinary text, as
most of a toxic text is ordinary; so what differs is their ends.  These are
learned by turns, from compressed lengths alone.  The training texts are in two
halves; each half's ends judge the other half's texts, and the ``PICKED`` words
of each toxic text that the toxic dictionary shortens most become the next toxic
end, those of as many ordinary texts the next ordinary end (which takes back
what ordinary text has as well).  A word that only one text has is not found
again in the other half, so after ``TURNS`` turns what toxic texts share is left.

Learning uses bounded samples: at most about ``SAMPLE_TEXTS`` texts of either label
for the dictionaries and as many for the calibration, chosen by a hash of the id,
and ``SAMPLE_WORDS`` words of each, from all over the text; copies of a text and
rows that repeat an id count once.  Held-out rows and rows without a label are
not learned from.  Everything else reads all rows, and whole texts.

Null and empty texts have no windows and get the score of a text without hits.
Where a doc_id has several labels the largest counts.  Repeated rows are rows of
their own.  Without texts of both labels in the calibration and toxic ones in
either half the score is 0.  Empty tables give no rows; extra columns are
ignored (``score`` keeps them, a column score is replaced).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, map_batches, others_than, table

SAMPLE_TEXTS, SAMPLE_WORDS, WINDOW, LONGEST, SEED, THRESHOLD = 1500, 200, 2, 24, 3, 0.3
BASE_BYTES, END_BYTES, PICKED, LEAST, TURNS = 64 << 10, 4 << 10, 3, 2, 6
#: zstandard looks for nothing in the last bytes, and keeps what it cannot shorten by two: a run of zeros sees to both.
PAD = bytes(24)
#: Nor does it index a dictionary's last bytes.
BEHIND = b"\n" * 16
#: Differences are counted from -16 to 31; what is beyond counts as these.  So many windows' are remembered.
LOWEST, CELLS, BLOCK, PIECE, MEMO = -16, 48, 50_000, 1 << 20, 300_000
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded length."""
    if text and len(text) <= PIECE:
        some = [WORDS.findall(text.lower())]
    else:  # a long text's words are never all in memory
        found = (m.group() for m in WORDS.finditer(text.lower())) if text else iter(())
        some = iter(lambda: list(islice(found, BLOCK)), [])
    for words in some:
        if max(map(len, words), default=0) > LONGEST:
            words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
        yield words


def _bytes(words: str) -> bytes:
    return f" {words} ".encode("utf-8", "replace")


class Distance:
    """Compressed lengths under the ordinary dictionary less those under the toxic one."""

    def __init__(self, base: bytes, ordinary: bytes, toxic: bytes):
        self.data, self.made, self.memo = (base, ordinary, toxic), None, {}

    def __getstate__(self) -> tuple:
        return self.data

    def __setstate__(self, data: tuple) -> None:
        self.__init__(*data)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self.made is None:
            params = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, window_log=20, chain_log=15, hash_log=15, search_log=6, min_match=4,
                target_length=64, write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            base, *ends = self.data
            size = max(map(len, ends))  # equal layouts, so that equal words cost the same
            dicts = [zstandard.ZstdCompressionDict(base + e.rjust(size) + BEHIND, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for e in ends]
            self.made = [zstandard.ZstdCompressor(dict_data=d, compression_params=params) for d in dicts]
        return self.made

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        if not parts:
            return np.zeros(0, int)
        sizes = np.array([len(p) + len(PAD) for p in parts], "<u8")
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype("<u8").tobytes()
        given = zstandard.BufferWithSegments(PAD.join(parts) + PAD, segments)
        ordinary, toxic = (np.array([len(x) for x in c.multi_compress_to_buffer(given)]) for c in self._compressors())
        return ordinary - toxic

    def cells(self, windows: list[str]) -> list[int]:
        """Of each window, the place of its difference in a spectrum."""
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        new = [w for w in dict.fromkeys(windows) if w not in memo]
        memo.update(zip(new, np.clip(self([_bytes(w) for w in new]) - LOWEST, 0, CELLS - 1).tolist()))
        return [memo[w] for w in windows]


class Model:
    def __init__(self, distance: Distance | None, threshold: int = 0, weights: np.ndarray | None = None):
        self.distance, self.threshold, self.weights = distance, threshold, weights

    def spectra(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, how many windows have which difference."""
        out = np.zeros((len(texts), CELLS), np.int64)
        pending: list[str] = []
        owners: list[tuple[int, int]] = []  # texts, and how many of the pending windows are theirs

        def count() -> None:
            cells, at = self.distance.cells(pending), 0
            for i, n in owners:
                out[i] += np.bincount(cells[at : at + n], minlength=CELLS)
                at += n
            pending.clear()
            owners.clear()

        for i, t in enumerate(texts):
            for words in words_of(t):
                if words:
                    some = [" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)]
                    pending += some
                    owners.append((i, len(some)))
                if len(pending) >= BLOCK:  # long texts take no more memory than others
                    count()
        count()
        return out

    @staticmethod
    def inputs(spectra: np.ndarray, threshold: int) -> np.ndarray:
        hits, size = spectra[:, threshold - LOWEST :].sum(axis=1), np.maximum(1, spectra.sum(axis=1))
        top = np.where(spectra > 0, np.arange(CELLS) + LOWEST, 0).max(axis=1, initial=0)
        return np.stack([np.ones(len(hits)), hits > 0, np.log1p(hits), 10 * np.sqrt(hits / size), np.maximum(0, top) / 4], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = self.inputs(self.spectra(texts), self.threshold) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, and the mean log likelihood; ``share``: so many rows each stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (share * (p - y)) + ridge * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float((share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / share.sum())


def _trained(parts: list[bytes], size: int) -> bytes:
    """A dictionary by zstandard's trainer; what is too little for it is one as it is."""
    try:
        return zstandard.train_dictionary(size, parts, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _end(picked: list[bytes]) -> bytes:
    """The words of a dictionary's end, the most frequent ones last, where references are shortest."""
    return (b"".join(w.rstrip() for w, _ in sorted(Counter(picked).items(), key=lambda x: (x[1], x[0]))) + b" ")[-END_BYTES:]


def learn(toxic: list[list[list[bytes]]], ordinary: list[list[list[bytes]]]) -> Distance:
    """The dictionaries, of two halves of toxic and of ordinary texts' words."""
    base = _trained([b"".join(t[i : i + 4]) for half in ordinary for t in half for i in range(0, len(t), 4)], BASE_BYTES)
    halves = [(ordinary[h][: max(50, len(toxic[h]))], toxic[h]) for h in (0, 1)]
    picked = [[[w for t in texts for w in t] for texts in half] for half in halves]
    for _ in range(TURNS):
        judges = [Distance(base, *map(_end, own)) for own in picked]
        for h in (0, 1):
            for kind, texts in enumerate(halves[h]):
                every = sorted({w for t in texts for w in t})
                found = dict(zip(every, judges[1 - h](every).tolist()))
                chosen: list[bytes] = []
                for t in texts:
                    best = sorted(((-found[w], w) for w in set(t) if found[w] >= LEAST))
                    chosen += [w for _, w in best[: max(1, min(PICKED, len(t) // 3))]]
                picked[h][kind] = chosen
    return Distance(base, *(_end(picked[0][k] + picked[1][k]) for k in (0, 1)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, texts: int, seed: int) -> tuple[list, DataFrame, dict]:
    """``y, half, kin, words`` of the training texts, the calibration's texts, and how many labelled texts each of these stands for."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    fold = fold_of(F.col("doc_id"), 4)
    mine = y.filter(fold != 2).withColumn("part", fold.cast("int"))
    counts = {(r["y"], r["part"]): r["count"] for r in mine.groupBy("y", "part").count().collect()}  # six numbers
    most = {0: texts // 2, 1: texts // 2, 3: texts}
    share = F.lit(0.0)
    for (kind, part), n in counts.items():
        share = F.when((F.col("y") == kind) & (F.col("part") == part), F.lit(min(1.0, most[part] / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # about four times ``texts`` ids at most, whatever the input: they find their texts without a shuffle of these
    chosen = mine.filter(place < share)
    names, types = ["doc_id", "y", "part", "kin", "words"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t, k, part in zip(*(c.to_pylist() for c in b.columns)):
                own = [w for some in words_of(t) for w in some]
                # the three words of the least hash stand for the text: copies of one text mostly share them, and count once
                kin = min((zlib.crc32(" ".join(p).encode("utf-8", "replace")) for p in zip(own, own[1:], own[2:])), default=zlib.crc32(" ".join(own).encode("utf-8", "replace")))
                step = max(1.0, len(own) / SAMPLE_WORDS)
                some = [own[int(i * step)] for i in range(min(len(own), SAMPLE_WORDS))]
                rows.append((key, k, part, kin, [_bytes(w) for w in some]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "part")
    words = map_batches(found.filter("part <> 3"), cut, "doc_id long, y int, part int, kin long, words array<binary>")
    once = words.groupBy("y", "part", "kin").agg(F.min(F.struct("doc_id", "words")).alias("r")).select("y", "part", "kin", "r.words")
    return sorted(map(tuple, once.collect())), found.filter("part = 3"), {k: max(1.0, n / texts) for (k, part), n in counts.items() if part == 3}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", texts: int = SAMPLE_TEXTS, seed: int = SEED) -> Model:
    rows, held, stands_for = _sample(docs, labels, label, texts, seed)
    of = lambda kind: [[[bytes(w) for w in r[3]] for r in rows if r[0] == kind and r[1] == h] for h in (0, 1)]
    toxic, ordinary = of(1), of(0)
    if not all(map(any, toxic)) or not any(map(any, ordinary)):
        return Model(None)
    model = Model(learn(toxic, ordinary))

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(model.spectra(b.column(0).to_pylist()).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([found, b.column(1), b.column(2)], ["s", "y", "doc_id"])

    seen = map_batches(held.select("text", "y", "doc_id"), spectra, "s array<long>, y int, doc_id long")
    rows = sorted(map(tuple, seen.groupBy("doc_id").agg(F.min("s").alias("s"), F.first("y").alias("y")).select("y", "s").collect()))
    if len({y for y, _ in rows}) < 2:
        return Model(None)
    found, ys = np.array([s for _, s in rows]), np.array([y for y, _ in rows], float)
    share = np.array([stands_for[y] for y, _ in rows])
    best = None
    for t in range(1, 13):
        w, fits = _logistic(Model.inputs(found, t), ys, share)
        if best is None or fits > best[0] + 1e-9:
            best = (fits, Model(model.distance, t, w))
    return best[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` instead of the column text."""
    others, schema = others_than(docs, "text", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(model.score(b.column(len(others)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], scores], [*others, "score"])

    return map_batches(docs.select(*(f"`{c}`" for c in others), "text"), run, ", ".join([*schema, "score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = (fold_of(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs.select("doc_id", held_out, "text"), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


ORACLE_SQL = None
