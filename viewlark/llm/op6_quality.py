"""Quality classifier: random Fourier features, ridge from normal equations, isotonic calibration.

Each whole text becomes ``STATISTICS`` (one pass over it).  Standardised by the
labelled rows' means and deviations, they are mapped to random Fourier features,
which approximate a Gaussian kernel.  Tasks sum their share of the normal
equations of ridge regression over all labelled rows, and the sums are added up
by rows of the matrix; the driver gets one matrix whose size is fixed by the
number of features.  Isotonic regression over a fixed grid of scores, counted on
a fold that the ridge has not seen, turns the score into a probability.

Only rows with a label and outside the held-out fold are learned from; labels,
lang, source and doc_id are never inputs of a score.

Null and empty texts have statistics of zeros and are scored like any other.
Labels that are null are no labels; where a doc_id has several, the largest
counts.  Repeated rows of documents are rows of their own.  Without labelled
rows of both classes every score is the share of label 1 (0.5 without any).
Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, map_batches, materialise, table

FEATURES, WIDTH, RIDGE, GRID, SEED, THRESHOLD = 256, 3.0, 1e-3, 2000, 6, 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "space", "newlines", "non_ascii",
    "entropy", "distinct_words", "repeats_next", "top_word", "repeated_pairs", "word_ends", "shouted_words", "piped_words",
)

_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", dtype=np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-.:;?", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256).astype(float)
    share = counts / len(raw)
    present = share[share > 0]
    words = text.split()
    n = len(words) or 1
    of = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), min(50.0, sum(len(w) * k for w, k in of.items()) / n),
        share[65:91].sum(), share[48:58].sum(), share[_PUNCTUATION].sum(), share[_SYMBOLS].sum(), share[[9, 32]].sum(), share[10], share[128:].sum(),
        float(-(present * np.log2(present)).sum()), len(of) / n, sum(k for (a, b), k in pairs.items() if a == b) / n,
        max(of.values(), default=0) / n, 1 - len(pairs) / max(1, n - 1), sum(not w[-1].isalnum() for w in of) / max(1, len(of)),
        sum(k for w, k in of.items() if w.isupper()) / n, sum(k for w, k in of.items() if not w[0].isalnum()) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row; ids of any type."""
    own = docs.select("doc_id", "text")
    return map_batches(own, _measure, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Fourier:
    """Standardised statistics to random Fourier features, the same for a seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([f, z, np.ones((len(x), 1))])


def _normal_equations(train: DataFrame, fourier: Fourier) -> np.ndarray:
    """Sum of the outer products of [features, label] over all rows of ``train`` (x, y)."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            a = np.hstack([fourier(np.array(f.x.tolist())), f.y.to_numpy(float)[:, None]])
            total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "v": list(total)})

    width = len(fourier.b) + len(fourier.mean) + 2
    parts = train.mapInPandas(partial, "row int, v array<double>").withColumn("block", F.col("row") % 16)

    def add_block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = [(int(r), np.sum(np.array(g.v.tolist()), axis=0)) for r, g in f.groupby("row")]
        return pd.DataFrame(out, columns=["row", "v"])

    # the partial sums of a few tasks at a time, and then those of all
    some = parts.withColumn("some", F.spark_partition_id() % 64)
    once = some.groupBy("block", "some").applyInPandas(add_block, "row int, v array<double>")
    twice = once.withColumn("block", F.col("row") % 16).groupBy("block").applyInPandas(add_block, "row int, v array<double>")
    out = np.zeros((width, width))
    for r in twice.collect():  # a matrix of fixed size
        out[r.row] = r.v
    return out


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Share of ones by grid cell, never falling (pool adjacent violators)."""
    pools: list[list[float]] = []
    for i in range(len(rows)):
        if rows[i]:
            pools.append([ones[i], rows[i], i])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], a[2]]
    if not pools:
        return np.full(len(rows), 0.5)
    # between the pools' ends the share is that of the next pool; strictness is not needed
    ends, shares = [p[2] for p in pools], [(p[0] + 0.5) / (p[1] + 1) for p in pools]
    return np.maximum.accumulate(np.array([shares[min(int(np.searchsorted(ends, i)), len(ends) - 1)] for i in range(len(rows))]))


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, curve: np.ndarray):
        self.fourier, self.weights, self.curve = fourier, weights, curve

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores, as places on the grid."""
        s = self.fourier(x) @ self.weights
        return np.clip((s + 0.5) / 2 * (len(self.curve) - 1), 0, len(self.curve) - 1).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.curve[0]) if self.weights is None else self.curve[self.raw(x)]


def fit(train: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, grid: int = GRID, seed: int = SEED) -> Model:
    """Fit on ``doc_id, x, y``: the ridge on three folds of four, the calibration on the fourth."""
    n = len(STATISTICS)
    sums = train.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)),
    ).first()
    if not sums["n"] or sums["ones"] in (0, sums["n"]):
        return Model(None, None, np.array([(sums["ones"] or 0) / sums["n"] if sums["n"] else 0.5]))
    fourier = Fourier(np.array([sums[f"m{i}"] for i in range(n)]), np.array([sums[f"s{i}"] for i in range(n)]), features, width, seed)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))
    s = _normal_equations(train.filter(part != 3).select("x", "y"), fourier)
    a, b = s[:-1, :-1], s[:-1, -1]
    rows = max(1.0, a[-1, -1])
    weights = np.linalg.solve(a + ridge * rows * np.eye(len(a)) / len(a), b)
    model = Model(fourier, weights, np.zeros(grid))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"cell": model.raw(np.array(f.x.tolist())) if len(f) else np.array([], int), "y": f.y})

    cells = train.filter(part == 3).select("x", "y").mapInPandas(place, "cell int, y int").groupBy("cell").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    ones, count = np.zeros(grid), np.zeros(grid)
    for r in cells.collect():  # at most as many as the grid has
        ones[r.cell], count[r.cell] = r.ones, r.n
    model.curve = isotonic(ones, count)
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with ``score``."""
    fields = [*((f.name, f.dataType.simpleString()) for f in measured.schema if f.name != "x"), ("score", "double")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="x").assign(score=model.score(np.array(f.x.tolist())) if len(f) else [])

    return measured.mapInPandas(run, ", ".join(f"`{a}` {b}" for a, b in fields))


def _labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: one label an id."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled(measured: DataFrame, labels: DataFrame, label: str, held_out: object) -> DataFrame:
    """``doc_id, x, y`` of the rows outside the held-out fold that have a label."""
    return measured.filter(~held_out).join(_labels(labels, label), "doc_id").select("doc_id", "x", "y")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score`` of every row of ``docs``."""
    held_out = fold_of(F.col("doc_id"), 5) == 0
    measured = materialise(measure(docs), "statistics")
    model = fit(labelled(measured, labels, "quality", held_out))
    return score(measured.withColumn("held_out", held_out), model)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    # texts with a label alone are measured for the fit, and all as they are scored: each once
    y = _labels(labels, "quality")
    train = docs.filter(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(y, "doc_id", "left_semi")
    model = fit(materialise(measure(train).join(y, "doc_id"), "statistics"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.array([statistics(t) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


ORACLE_SQL = None
