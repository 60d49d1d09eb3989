"""Language of texts by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; for every bit a logistic classifier over hashed byte trigrams says on which side a
text lies. Decoding sums each language's losses over the bits, weighted by how well the bit's classifier did on rows it
was not fitted to, and takes the least. `ambiguous` marks a small gap to the second.

The fit takes at most `most` rows, `each` of a language at most (parameters); tasks turn them into n-grams, so that the
driver gets at most 48 kB of each, however long its text. Whole texts are scored, one by one, in the task that reads them.

Edge cases: a null text, or one without any letter, is `und` with score 0; with nothing to learn from, every text is
`und`; equal texts get equal results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import rows_of
from tierwalk.llm.sample import labelled

BITS = 13
LETTER = regex.compile(r"\p{L}")
OUT = "doc_id long, lang_pred string, score double, ambiguous boolean"


def grams(text: str) -> np.ndarray:
    """Square roots of hashed trigram counts, scaled to length one."""
    a = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    codes = ((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    x = np.sqrt(np.bincount(codes.astype(np.int32), minlength=1 << BITS).astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: every split into two sides up to five languages, else random columns whose rows lie farthest apart."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = [[1 if j == 0 or (c >> (j - 1)) & 1 else -1 for j in range(n)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, np.float32).T
    rng, width, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width)).astype(np.float32)
        least = int(((width - code @ code.T) / 2 + np.eye(n) * width).min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows x languages) and gaps between the two best losses."""
        margins = x @ self.weights + self.bias
        losses = np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(axis=1) for row in self.code], axis=1)
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        ranked = np.sort(losses, axis=1)
        gap = ranked[:, 1] - ranked[:, 0] if losses.shape[1] > 1 else np.full(len(x), np.inf)
        return p / p.sum(axis=1, keepdims=True), gap


def fit(rows: list[tuple[np.ndarray, str]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-5) -> Model | None:
    """From (grams, language): Adam on the logistic loss of all bits at once; every fifth row only weighs the bits."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    code = codewords(len(languages))
    x = np.stack([g for g, _ in rows])
    y = code[[languages.index(lang) for _, lang in rows]]
    test = np.arange(len(rows)) % 5 == 4
    if len(rows) < 50:
        test[:] = False
    xf, yf = x[~test], y[~test]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        pull = -yf / (1 + np.exp(np.clip(yf * (xf @ w + b), -30, 30))) / len(xf)
        g = xf.T @ pull + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * pull.sum(axis=0)
    xt, yt = (x[test], y[test]) if test.any() else (x, y)
    right = ((xt @ w + b) * yt > 0).mean(axis=0)
    trust = np.log((right + 0.02) / (1.02 - right)).clip(0.05, 4)
    return Model(languages, code, w, b, (trust / trust.sum() * len(trust)).astype(np.float32))


def _gram_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, label, place, value) of the rows with a letter: the grams that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            held = [(i, grams(t)) for i, t in enumerate(batch.column(1).to_pylist()) if t and LETTER.search(t)]
            places = [np.flatnonzero(g) for _, g in held]
            some = batch.take(pa.array([i for i, _ in held], pa.int64()))
            values = [g[p].astype("<f4").tobytes() for (_, g), p in zip(held, places, strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "place", "value"])

    return rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label string, place binary, value binary")


def train(docs: DataFrame, learn: Column, most: int = 3000, each: int = 600) -> Model | None:
    rows = _gram_rows(labelled(docs, docs, "lang", learn, most, each)).collect()
    held = []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.place, r.value)):
        x = np.zeros(1 << BITS, np.float32)
        x[np.frombuffer(r.place, "<u2")] = np.frombuffer(r.value, "<f4")
        held.append((x, r.label))
    return fit(held)


def predict(docs: DataFrame, model: Model | None, unsure: float = 0.5) -> DataFrame:
    """OUT for every row: a language of the model or `und`, its share of the decoded weight, and whether it was close."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in rows_of(batches, 256):
            found = batch.column(1).to_pylist()
            read = [i for i, t in enumerate(found) if known and t and LETTER.search(t)]
            lang, score, close = ["und"] * len(found), [0.0] * len(found), [True] * len(found)
            if read:
                p, gap = known.decode(np.stack([grams(found[i]) for i in read]))
                for i, best, q, g in zip(read, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), gap.tolist(), strict=True):
                    lang[i], score[i], close[i] = known.languages[best], min(max(q, 0.0), 1.0), g < unsure
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def by_fold(predicted: DataFrame, fold: Column) -> DataFrame:
    return predicted.select("doc_id", fold.alias("held_out"), "lang_pred", F.col("score"), "ambiguous")
