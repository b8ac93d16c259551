"""Language identification with a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of ``LENGTH`` bytes that overlap by the
widest filter less one, so that every byte sequence of a whole text is seen.  A
window's bytes are embedded; filters of several widths slide over them; each
filter's maximum goes through a linear layer and a softmax.  The text's score
for a language is the mean of its windows' probabilities, so that a text in two
languages is of the one that has more of it.

The network is fitted on a bounded sample: of each language about
``SAMPLE_TEXTS`` texts (chosen by a hash of their id, the same each time, among
rows with a language and outside the held-out fold), and ``SAMPLE_WINDOWS``
windows of each, from anywhere in the text.  Everything else reads all rows.
lang, source and doc_id are never inputs of a prediction.

Null texts and texts without a letter get the language ``und`` and score 0.
Repeated rows are rows of their own.  Without a labelled row every text is
``und``.  Empty tables give no rows.  Extra columns are ignored, and kept by
``keep`` and ``identify``, which replaces columns named as its own.  Languages are
few: more than ``LANGUAGES`` different values of lang are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, map_batches, others_than, table

SAMPLE_TEXTS, SAMPLE_WINDOWS, LENGTH, WIDTHS, FILTERS, EMBEDDING = 2500, 3, 128, (2, 3, 4, 5), 12, 8
EPOCHS, BATCH, RATE, SEED, UND, LANGUAGES, MARGIN = 6, 64, 0.004, 2, "und", 1000, 0.1
PAD = 256
CHUNK = 128  # windows at a time: their columns stay in the cache


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.reach = languages, max(WIDTHS)
        total = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.reach * EMBEDDING, total), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
        normal = lambda *shape, scale: rng.normal(size=shape, scale=scale).astype(np.float32)
        self.p = {
            "e": normal(PAD + 1, EMBEDDING, scale=0.5), "w": normal(*self.mask.shape, scale=0.2) * self.mask, "b": np.zeros(total, np.float32),
            "v": normal(total, len(languages), scale=0.1), "c": np.zeros(len(languages), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"][x]
        n, length, d = e.shape
        view = np.lib.stride_tricks.as_strided(e, (n, length - self.reach + 1, self.reach * d), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """``x``: windows as rows of byte values, PAD behind the end."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), CHUNK):
            cols = self._columns(x[i : i + CHUNK])
            n, places, k = cols.shape
            top = (cols.reshape(-1, k) @ self.p["w"]).reshape(n, places, -1).max(axis=1)
            z = np.maximum(top + self.p["b"], 0) @ self.p["v"] + self.p["c"]
            z -= z.max(axis=1, keepdims=True)
            out[i : i + n] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradients(self, xb: np.ndarray, yb: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; it reaches each filter's best place only."""
        cols = self._columns(xb)
        n, places, k = cols.shape
        conv = (cols.reshape(-1, k) @ self.p["w"]).reshape(n, places, -1)
        best = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + self.p["b"]
        h = np.maximum(pooled, 0)
        z = h @ self.p["v"] + self.p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), yb] -= 1
        q /= n
        dh = (q @ self.p["v"].T) * (pooled > 0)
        at = cols[np.arange(n)[:, None], best]  # what each filter saw at its best place
        dat = dh[:, :, None] * (self.p["w"] * self.mask).T[None]
        de = np.zeros_like(self.p["e"])
        seen = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(self.reach)]
        np.add.at(de, seen.reshape(-1), dat.reshape(-1, EMBEDDING))
        return {"e": de, "w": np.einsum("nfk,nf->kf", at, dh) * self.mask, "b": dh.sum(0), "v": h.T @ q, "c": q.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        """Adam on cross entropy."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, EPOCHS * max(1, len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                xb, yb = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
                grads = self.gradients(xb, yb)
                step += 1
                rate = RATE * (1 - step / (total + EPOCHS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in grads.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and the texts' ends in it; null is empty."""
    b = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
    data = np.frombuffer(b.buffers()[2], np.uint8) if len(b) and b.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(LENGTH)
    out = data[np.minimum(at, max(0, len(data) - 1))].astype(np.int16) if len(data) else np.zeros(at.shape, np.int16)
    out[at >= ends[:, None]] = PAD
    return out


def predict(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into ``net.languages`` (-1: und) and scores."""
    data, ends = flat_bytes(texts)
    step = LENGTH - net.reach + 1
    sizes = np.diff(ends)
    count = np.maximum(1, -(-(sizes - net.reach + 1) // step))
    first = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros((len(sizes), len(net.languages)))
    doc = np.repeat(np.arange(len(sizes)), count)
    start = ends[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * step
    for i in range(0, len(doc), 1 << 14):
        d = doc[i : i + (1 << 14)]
        p = net.log_probabilities(windows(data, start[i : i + (1 << 14)], ends[1:][d]))
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        total[d[cut]] += np.add.reduceat(np.exp(p), cut, axis=0)
    q = total / count[:, None]
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    return np.where(lettered, q.argmax(axis=1), -1), np.where(lettered, q.max(axis=1), 0.0)


def fit(docs: DataFrame, held_out: object, texts: int = SAMPLE_TEXTS, per_text: int = SAMPLE_WINDOWS, seed: int = SEED) -> Network | None:
    """Train on about ``texts`` texts of each language of ``docs`` outside ``held_out``."""
    usable = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in docs.filter(~held_out & F.col("lang").isNotNull()).groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} values of lang: is this column one of languages?")
    if not counts:
        return None
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, texts / n)))))
    # the hash of the id as a number from 0 to 1
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(place < share[F.col("lang")]).select("lang", "text", F.xxhash64("doc_id", F.lit(seed + 1)).alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = flat_bytes(b.column(1))
            doc = np.repeat(np.arange(len(b)), per_text)
            sizes = np.diff(ends)[doc]
            # places and lengths follow from the id alone; three windows in ten are cut short
            drawn = [np.random.default_rng(h & 0xFFFFFFFF).random((per_text, 3)) for h in b.column(2).to_pylist()]
            r = np.concatenate(drawn) if drawn else np.zeros((0, 3))
            start = ends[:-1][doc] + (r[:, 0] * np.maximum(1, sizes - LENGTH + 1)).astype(np.int64)
            end = np.minimum(ends[1:][doc], start + np.where(r[:, 1] < 0.3, 8 + (r[:, 2] * (LENGTH - 7)).astype(np.int64), LENGTH))
            x = windows(data, start, end).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(list(map(bytes, x.astype("<i2"))), pa.binary())], ["lang", "w"])

    rows = map_batches(sample, cut, "lang string, w binary").toArrow().sort_by([("lang", "ascending"), ("w", "ascending")])
    names = sorted(set(rows.column("lang").to_pylist()))
    if not names:
        return None
    net = Network(names, seed)
    y = np.array([names.index(v) for v in rows.column("lang").to_pylist()])
    net.train(np.array([np.frombuffer(v, "<i2") for v in rows.column("w").to_pylist()]), y, seed)
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` (with a column text) with ``lang_pred`` and ``score`` instead of the text."""
    others, schema = others_than(docs, "text", "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = predict(net, b.column(len(others))) if net else (np.full(len(b), -1), np.zeros(len(b)))
            names = pa.array([*(net.languages if net else []), UND]).take(pa.array(np.where(best < 0, len(net.languages) if net else 0, best)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], names, pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    return map_batches(docs.select(*(f"`{c}`" for c in others), "text"), run, ", ".join([*schema, "lang_pred string", "score double"]))


def keep(docs: DataFrame, net: Network | None, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with some certainty.

    A score is that of chance, one over the number of languages, or more; ``margin``
    is the part of what is above chance that it must reach, whatever their number.
    """
    chance = 1 / len(net.languages) if net else 0.0
    reject_below = chance + margin * (1 - chance) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = predict(net, b.column("text")) if net else (np.full(len(b), -1), np.zeros(len(b)))
            yield b.filter(pa.array((best >= 0) & (score >= reject_below)))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    net = fit(docs, held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), net)


ORACLE_SQL = None
