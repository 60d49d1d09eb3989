"""Quality of texts: ridge regression on random Fourier features of text statistics, calibrated by isotonic regression.

Statistics of each whole text are drawn through cosines of random projections, whose inner products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the sums are one matrix of fixed size. The raw
score is mapped to a probability by isotonic regression on rows that did not enter the equations.

The fit takes at most `most` labelled rows (parameter); scoring covers every row and whole texts.

Edge cases: null and empty texts count as a text of no words and get a score like any other; with no labels, every score
is 0.5; where no row was left out of the equations, the raw score itself counts, cut to 0 and 1; rows of one raw score share
one calibrated score, whatever their labels; equal texts get equal scores; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import materialise, rows_of
from tierwalk.llm.sample import labelled

#: Classes of bytes: lower, upper, digit, blank, line end, stops, marks, beyond ASCII.
CLASS = np.full(256, 6, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 7
CLASS[[9, 11, 12, 13, 32]], CLASS[10], CLASS[[33, 44, 46, 63, 58, 59, 39, 34, 45]] = 3, 4, 5
#: Marks that get a share of their own.
MARKS = np.frombuffer(b"#$%&*|!<>{}=/\\@_+~^()[]", np.uint8)


def statistics(text: bytes) -> np.ndarray:
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(CLASS, weights=counts, minlength=8) / n
    words = text.split()
    w = max(len(words), 1)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum(), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return np.array(
        [
            *classes,
            *(counts[MARKS] / n * 4),
            np.log1p(n),
            np.log1p(len(words)),
            lengths.mean() / 10,
            lengths.std() / 10,
            np.log1p(lengths.max()),
            len(tally) / w,
            len(tally) / w**0.75,
            max(tally.values(), default=0) / w,
            sum(map(operator.eq, words, words[1:])) / w,
            sum(not x[:1].isalpha() and x[0] < 128 for x in tally) / max(len(tally), 1),
            sum(x[-1] < 128 and not x[-1:].isalnum() for x in tally) / max(len(tally), 1),
            counts[65:91].sum() / letters,
            np.log1p(len(lines)),
            np.log1p(len(text) / max(len(lines), 1)),
            len(set(lines)) / max(len(lines), 1),
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.project + self.shift) * (2 / self.project.shape[1]) ** 0.5
        return np.hstack([wave, z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots are the blocks' mean raw scores, the ends a little inside 0 and 1."""
    blocks: list[list[float]] = []  # mean of y, weight, sum of raw
    values, place, count = np.unique(raw, return_inverse=True, return_counts=True)
    means = np.bincount(place, y) / count
    for r, v, n in zip(values.tolist(), means.tolist(), count.tolist(), strict=True):
        blocks.append([v, n, r * n])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, r2 = blocks.pop()
            v1, w1, r1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, r1 + r2]
    # One success and one failure more in each block keep small blocks from the ends.
    base = float(y.mean())
    knots = np.array([r / w for _, w, r in blocks])
    levels = np.maximum.accumulate(np.array([(v * w + 2 * base) / (w + 2) for v, w, _ in blocks]))
    wide = max(float(np.ptp(raw)), 1e-6)
    return np.concatenate(([knots[0] - wide], knots, [knots[-1] + wide])), np.concatenate(([levels[0] * 0.5], levels, [1 - (1 - levels[-1]) * 0.5]))


def stats_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, label, stats array) of (doc_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            x = [statistics(t or b"").tolist() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "stats"])

    return rows.select("doc_id", F.col("label").cast("double").alias("label"), "text").mapInArrow(run, "doc_id long, label double, stats array<double>")


def _sums(rows: DataFrame, f, size: int) -> np.ndarray:
    """Sum of f(stats, labels) -> vector over all rows: one vector a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(np.array(batch.column(1).to_pylist()), batch.column(0).to_numpy())
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("label", "stats").mapInArrow(run, "part binary").toLocalIterator()
    return sum((np.frombuffer(p.part) for p in parts), np.zeros(size))


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 12000, waves: int = 256, ridge: float = 1e-3, seed: int = 11, label: str = "quality") -> Model:
    d = len(statistics(b""))
    rows = materialise(stats_rows(labelled(docs, labels, label, learn, most)), "quality").coalesce(4)
    part = F.crc32(F.concat_ws("/", F.lit("fit"), F.col("doc_id")).cast("binary")) % 4
    moments = _sums(rows, lambda x, y: np.concatenate((x.sum(axis=0), (x * x).sum(axis=0), [len(x)])), 2 * d + 1)
    n = max(moments[-1], 1)
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d : 2 * d] / n - mean**2, 0)) + 0.02
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / d**0.5, (d, waves)), rng.uniform(0, 2 * np.pi, waves), np.empty(0), np.empty(0), np.empty(0))
    if not moments[-1]:
        return model
    width = waves + d + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _sums(rows.where(part != 0), equations, width * width + width)
    gram, right = sums[:-width].reshape(width, width), sums[-width:]
    penalty = np.full(width, ridge * n)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(penalty) + np.eye(width) * 1e-9, right)
    held = rows.where(part == 0).select("label", "stats").collect()  # a quarter of the bounded sample, a few hundred bytes a row
    if not held:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    raw = model.features(np.array([r.stats for r in held])) @ model.weights
    model.knots, model.levels = isotonic(raw, np.array([r.label for r in held]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            x = np.stack([statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows whose score is at least `least`, with all their columns."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            x = np.stack([statistics((t or "").encode()) for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(sent.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
