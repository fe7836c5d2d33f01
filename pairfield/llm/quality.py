"""Quality scores: ridge regression on random Fourier features of text statistics, calibrated isotonically.

1. Statistics: each text becomes a few numbers (shares of character classes, repetition of words
   and lines, lengths, entropy), standardised over the learning rows.
2. Random Fourier features: cosines of random projections, whose products approximate a Gaussian
   kernel between statistics.
3. Normal equations: each task sums z z' and z y of its learning rows, by fold; a few tasks add
   these up, and the driver solves one ridge system for each fold left out and one for all.
4. Isotonic calibration: each fold's rows are scored by the model that didn't see them; counts of
   labels by bins of that score are made monotone by pooling adjacent violators.

A null text counts as the empty one, whose statistics are all 0; a long one is read whole. Several
labels of one document count as their rounded mean; null labels don't count. Without labels every
score is 0.5. Scores depend on text alone, so equal texts and repeated rows have equal scores; a null
doc_id counts as the empty string when rows are held out. An empty table gives an empty result. Only
the id, the text and the labels are read, so names of other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialised
from .langid import held_out

FEATURES, RIDGE, SEED, BINS, FOLDS = 128, 1e-3, 4_20, 1024, 4
THRESHOLD = 0.7
STATISTICS = ("size", "upper", "lower", "digit", "stop", "symbol", "bang", "bar", "space", "newline", "beyond", "entropy", "distinct_words", "top_word", "word_size", "distinct_lines", "capitalised", "odd_ends")


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for one text."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    share = lambda chars: int(counts[list(chars)].sum()) / n
    p = counts[counts > 0] / n
    words = text.split()
    lines = text.split("\n")
    w = max(len(words), 1)
    seen = Counter(words)
    return [
        float(np.log1p(n)), int(counts[65:91].sum()) / n, int(counts[97:123].sum()) / n, int(counts[48:58].sum()) / n,
        share(b".,;:?"), share(b"#$%&*+=<>@^_~{}[]\\/"), share(b"!"), share(b"|"), share(b" \t"), share(b"\n"), int(counts[128:].sum()) / n,
        float(-(p * np.log(p)).sum()), len(seen) / w, max(seen.values(), default=0) / w, float(np.log1p(n / w)), len(set(lines)) / len(lines),
        sum([x[0].isupper() for x in words]) / w, sum([not x[-1].isalnum() and x[-1] not in ".,;:?" for x in words]) / w,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row's text."""
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield batch_of(schema, doc_id=batch.column(0), **{s: rows[:, i] for i, s in enumerate(STATISTICS)})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)]))


class Kernel:
    """Random Fourier features of standardised statistics, with the statistics themselves and a constant."""

    def __init__(self, means: list[float], spreads: list[float], features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.means, self.spreads = np.array(means), np.array(spreads)
        self.weights = rng.normal(0, 1 / np.sqrt(len(means)), (len(means), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.means) / self.spreads, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.weights + self.phases), x, np.ones((len(x), 1))])


def pooled(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to positive / n (least squares weighted by n): adjacent violators pooled."""
    blocks: list[list[float]] = []
    for a, b in zip(n, positive):
        blocks.append([float(a), float(b), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a2, b2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k2]
    return np.array([b / a for a, b, k in blocks for _ in range(int(k))])


class Model:
    """Ridge weights and a calibration; scores rows of statistics."""

    def __init__(self, kernel: Kernel | None = None, weights: np.ndarray | None = None, at: np.ndarray | None = None, value: np.ndarray | None = None):
        self.kernel, self.weights, self.at, self.value = kernel, weights, at, value

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(rows), 0.5)
        raw = self.kernel(rows) @ self.weights
        calibrated = np.interp(raw, self.at, self.value)
        # within a pooled block the raw score still orders texts
        return np.round(np.clip(0.99 * calibrated + 0.01 * np.clip(raw, 0, 1), 0, 1), 6)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(int)


def fit(rows: DataFrame, ridge: float = RIDGE) -> Model:
    """The model of rows: the statistics, y (0 or 1) and fold (0 to FOLDS - 1)."""
    moments = rows.agg(F.count("y").alias("n"), *(f(s).alias(f"{k}_{s}") for s in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return Model()
    kernel = Kernel([moments[f"m_{s}"] for s in STATISTICS], [moments[f"s_{s}"] or 1.0 for s in STATISTICS])
    size = FEATURES + len(STATISTICS) + 1
    schema = pa.schema([("task", pa.int64()), ("sums", pa.binary())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, fold = kernel(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                a = z[fold == f]
                total[f] += a.T @ np.column_stack([a, y[fold == f]])
        yield batch_of(schema, task=[0], sums=[total.tobytes()])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * size * (size + 1))
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x)
        yield batch_of(schema, task=[0], sums=[total.tobytes()])

    partial = rows.select(*STATISTICS, "y", "fold").mapInArrow(sums, "task long, sums binary").repartition(8).mapInArrow(added, "task long, sums binary")
    total = sum(np.frombuffer(r["sums"]) for r in partial.collect()).reshape(FOLDS, size, size + 1)  # eight rows

    def solved(t: np.ndarray) -> np.ndarray:
        n = max(t[-1, size - 1], 1.0)
        return np.linalg.solve(t[:, :size] + ridge * n * np.eye(size), t[:, size])

    everything = solved(total.sum(axis=0))
    others = [solved(total.sum(axis=0) - total[f]) for f in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            z, y, fold = kernel(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            at = _bin((z * np.array(others)[fold]).sum(axis=1))
            n += np.bincount(at, minlength=BINS)
            positive += np.bincount(at, y, BINS)
        used = np.flatnonzero(n)
        yield batch_of(pa.schema([("bin", pa.int32()), ("n", pa.int64()), ("p", pa.int64())]), bin=used, n=n[used].astype(int), p=positive[used].astype(int))

    found = rows.select(*STATISTICS, "y", "fold").mapInArrow(binned, "bin int, n long, p long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()  # BINS rows at most
    found = sorted(found, key=lambda r: r["bin"])
    value = pooled(np.array([r["n"] for r in found]), np.array([r["p"] for r in found]))
    return Model(kernel, everything, np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in found]), value)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; learnt from labelled rows whose crc32(doc_id) leaves another remainder."""
    stats = materialised(with_statistics(docs))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")  # another hash than the one that holds rows out
    model = fit(stats.where(~held_out(F.col("doc_id"), mod, remainder)).join(known, "doc_id").withColumn("fold", fold))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, doc_id=batch.column("doc_id"), score=model(_matrix(batch)))

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
