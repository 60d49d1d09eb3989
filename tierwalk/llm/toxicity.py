"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector, if the fit knew it, beside the mean of the vectors of its letter trigrams. Both
directions read windows of `STEPS` words; attention over the joined states gives one logit a window. A text's score is
that of its worst window, over all windows, which overlap and reach from the first word to the last.

The labels are those of whole texts. In the fit, a text therefore answers for its highest window (and a clean one for a
second, random one). Vectors start from the words' log odds in the labelled sample. The fit takes at most `most` labelled
rows and of each at most `FIT_WORDS` words, as evenly spread windows (parameters), so that what reaches the driver is bounded;
it is repeatable. Scoring reads every word: windows of `STEPS` words start every `STRIDE`, so that any run of 17 words lies whole
in one.

Edge cases: null and empty texts are one window of padding, scored as such; texts shorter than a window are padded; with
no labels or one class only, every score is 0; equal texts get equal scores; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import rows_of
from tierwalk.llm.sample import labelled

STEPS, STRIDE = 32, 16
#: Words of a labelled text that the fit sees at most.
FIT_WORDS = 2048
HIDDEN, WORD, CHAR, ATTEND = 8, 8, 8, 8
GRAM_BITS = 12
#: Bytes after lower-casing: letters, digits and all beyond ASCII stand, the rest parts words.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split()


def starts(n: int) -> list[int]:
    """First words of all windows of n words; the last window ends with the last word."""
    return [0] if n <= STEPS else [*range(0, n - STEPS, STRIDE), n - STEPS]


def gram_means(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Mean trigram vector of each word, blanks around it included."""
    a = np.frombuffer(b"".join(b" %b " % w for w in words), np.uint8).astype(np.uint32)
    codes = ((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(n + 2)[:-1]))
    # Trigrams across two words fall out: of a word's n + 2 bytes, n start one.
    sums = np.concatenate((np.zeros((1, table.shape[1]), table.dtype), np.cumsum(table[codes.astype(np.int64)], axis=0, dtype=np.float64).astype(np.float64)))
    return ((sums[first + n] - sums[first]) / n[:, None]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Vectors of words: own and trigrams'."""
        own = self.p["word"][np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))]
        return np.hstack([own, gram_means(words, self.p["gram"])])

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions."""
        return np.hstack([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]]).astype(np.float32)

    def _run(self, gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States (steps x windows x hidden) of one direction."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((len(gates), gates.shape[1], HIDDEN), np.float32)
        for t in range(len(gates)):
            hu = h @ u
            zr = sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, hu, z, r, n))
            out[t] = h = new
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray | None = None, tape: dict | None = None) -> np.ndarray:
        """Logits of windows from gate inputs (steps x windows x 6 hidden)."""
        forth, back = ([], []) if tape is not None else (None, None)
        s = np.concatenate([self._run(gates[:, :, : 3 * HIDDEN], self.p["uf"], mask, forth), self._run(gates[::-1, :, 3 * HIDDEN :], self.p["ub"], mask[::-1] if mask is not None else None, back)[::-1]], axis=2)
        a = np.tanh(s @ self.p["aw"])
        e = a @ self.p["av"]
        if mask is not None:
            e = np.where(mask, e, -30)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        c = np.einsum("tb,tbk->bk", e, s)
        if tape is not None:
            tape.update(s=s, a=a, e=e, c=c, forth=forth, back=back)
        return c @ self.p["ow"] + self.p["ob"][0]

    def backward(self, x: np.ndarray, mask: np.ndarray, tape: dict, pull: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the inputs x (steps x windows x size)."""
        p, s, a, e, c = self.p, tape["s"], tape["a"], tape["e"], tape["c"]
        g = {"ow": c.T @ pull, "ob": np.array([pull.sum()])}
        dc = pull[:, None] * p["ow"]
        de = np.einsum("bk,tbk->tb", dc, s)
        de = e * (de - (e * de).sum(axis=0))
        da = de[:, :, None] * p["av"] * (1 - a * a)
        g["av"] = np.einsum("tb,tbk->k", de, a)
        g["aw"] = np.einsum("tbi,tbj->ij", s, da)
        ds = e[:, :, None] * dc + da @ p["aw"].T
        dx = np.zeros_like(x)
        for w, u, b, steps, part, flip in (("wf", "uf", "bf", tape["forth"], slice(0, HIDDEN), False), ("wb", "ub", "bb", tape["back"], slice(HIDDEN, None), True)):
            order = range(len(x)) if flip else range(len(x) - 1, -1, -1)
            g[w], g[u], g[b] = np.zeros_like(p[w]), np.zeros_like(p[u]), np.zeros_like(p[b])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in order:
                h, hu, z, r, n = steps[len(x) - 1 - t if flip else t]
                on = mask[t][:, None]
                dh = dh + ds[t][:, part]
                dnew = np.where(on, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * hu[:, 2 * HIDDEN :] * r * (1 - r)
                gates = np.hstack([dz, dr, dn])
                through = np.hstack([dz, dr, dn * r])
                g[w] += x[t].T @ gates
                g[b] += gates.sum(axis=0)
                g[u] += h.T @ through
                dx[t] += gates @ p[w].T
                dh = np.where(on, dnew * z + through @ p[u].T, dh)
        return g, dx


def fit(rows: list[tuple[list[bytes], int]], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5, vocabulary: int = 20_000, least: int = 3) -> Network | None:
    """From (words, 0 or 1)."""
    rng = np.random.default_rng(seed)
    y = np.array([int(v) for _, v in rows])
    if not len(y) or y.min() == y.max():
        return None
    # All words of the sample get numbers of their own here, so that windows are rows of one array.
    numbers: dict[bytes, int] = {}
    coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int32) for t, _ in rows]
    words = list(numbers) or [b"-"]
    holds, bad = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for c, v in zip(coded, y, strict=True):
        seen = np.unique(c)
        holds[seen] += 1
        bad[seen] += v
    every = {w: n for w, n in zip(words, holds.tolist(), strict=True) if n >= least}
    bad = dict(zip(words, bad.tolist(), strict=True))
    known = [w for w, n in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]]
    ids = {w: i for i, w in enumerate(known, 1)}
    share = y.mean()
    odds = np.array([0.0, *(np.log((bad[w] + 2 * share) / (every[w] - bad[w] + 2 * (1 - share)) * (1 - share) / share) for w in known)])
    size = WORD + CHAR

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / shape[0] ** 0.5, shape).astype(np.float32)

    p = {"word": (rng.normal(0, 0.05, (len(known) + 1, WORD))).astype(np.float32), "gram": rng.normal(0, 0.1, (1 << GRAM_BITS, CHAR)).astype(np.float32), "aw": draw(2 * HIDDEN, ATTEND), "av": draw(ATTEND), "ow": draw(2 * HIDDEN), "ob": np.array([-1.0], np.float32)}
    p["word"][:, 0] = np.clip(odds, -3, 3)
    p["word"][0] = 0
    for d in "fb":
        p |= {f"w{d}": draw(size, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    net = Network(ids, p)
    own = np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))
    grams = [np.frombuffer(b" %b " % w, np.uint8).astype(np.uint32) for w in words]
    codes = [(((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64) for a in grams]
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            place = [(k, s) for k in part.tolist() for s in starts(len(coded[k]))]
            seq = np.zeros((STEPS, len(place)), np.int64)
            mask = np.zeros((STEPS, len(place)), bool)
            for j, (k, s) in enumerate(place):
                got = coded[k][s : s + STEPS]
                seq[: len(got), j] = got
                mask[: len(got), j] = True
            seen, back = np.unique(seq, return_inverse=True)
            x = np.hstack([p["word"][own[seen]], np.stack([p["gram"][codes[w]].mean(axis=0) for w in seen.tolist()])]).astype(np.float32)
            logits = net.forward(net.projected(x)[back.reshape(seq.shape)], mask)
            owner = np.array([k for k, _ in place])
            chosen = []
            for k in part.tolist():
                mine = np.flatnonzero(owner == k)
                chosen.append(int(mine[logits[mine].argmax()]))
                if not y[k] and len(mine) > 1:
                    chosen.append(int(rng.choice(mine)))
            chosen = np.array(chosen)
            at = back.reshape(seq.shape)[:, chosen]
            tape: dict = {}
            out = net.forward(net.projected(x)[at], mask[:, chosen], tape)
            want = y[owner[chosen]]
            pull = ((sigmoid(out) - want) * np.where(want == 1, 2.0, 1.0) / len(chosen)).astype(np.float32)
            g, dx = net.backward(x[at], mask[:, chosen], tape, pull)
            dwords = np.zeros_like(x)
            np.add.at(dwords, at[mask[:, chosen]], dx[mask[:, chosen]])
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], own[seen], dwords[:, :WORD])
            g["word"][0] = 0
            touched = np.flatnonzero(np.abs(dwords).sum(axis=1))
            for j in touched.tolist():
                c = codes[int(seen[j])]
                np.add.at(g["gram"], c, dwords[j, WORD:] / len(c))
            step += 1
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.99 * v2[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (0.5 ** (epoch // 2)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores of texts, with the gate inputs of words kept up to a bound."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if not new:
            return
        n = len(self.rows)
        if n + len(new) > len(self.gates):
            grown = np.zeros((max(2 * len(self.gates), n + len(new)), 6 * HIDDEN), np.float32)
            grown[:n] = self.gates[:n]
            self.gates = grown
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.gates[n + i : n + i + len(part)] = self.net.projected(self.net.inputs(part))
        self.rows.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: list[str], block: int = 4096) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        best = np.full(len(docs), -np.inf)
        if len(self.rows) > self.most:
            self.clear()
        seqs, owners, short = [], [], []
        for i, words in enumerate(docs):
            missing = [w for w in words if w not in self.rows]
            if missing:
                self._learn(missing)
            ids = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            if len(words) < STEPS:
                short.append((i, ids))
                continue
            at = starts(len(words))
            seqs.append(np.lib.stride_tricks.sliding_window_view(ids, STEPS)[at])
            owners.append(np.full(len(at), i))
        if seqs:
            seq, owner = np.concatenate(seqs), np.concatenate(owners)
            for i in range(0, len(seq), block):
                np.maximum.at(best, owner[i : i + block], self.net.forward(self.gates[seq[i : i + block].T]))
        if short:
            seq, mask = np.zeros((STEPS, len(short)), np.int64), np.zeros((STEPS, len(short)), bool)
            for j, (_, ids) in enumerate(short):
                seq[: len(ids), j], mask[: len(ids), j] = ids, True
            np.maximum.at(best, np.array([i for i, _ in short]), self.net.forward(self.gates[seq], mask))
        return sigmoid(best)


def spread(words: list[bytes], most: int = FIT_WORDS) -> list[bytes]:
    """All words, or of a longer text so many in evenly spread runs of STEPS."""
    if len(words) <= most:
        return words
    return [w for s in np.linspace(0, len(words) - STEPS, most // STEPS).astype(int).tolist() for w in words[s : s + STEPS]]


def _word_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, words, label), words parted by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            words = [b" ".join(spread(words_of(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), batch.column(2)], names=["doc_id", "words", "label"])

    return rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, words binary, label int")


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 10_000, label: str = "toxic") -> Network | None:
    rows = _word_rows(labelled(docs, labels, label, learn, most)).collect()
    return fit([(r.words.split(), r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.words))])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in rows_of(batches, 256):
            found = [t or "" for t in batch.column(1).to_pylist()]
            values = scorer(found) if scorer else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(values, 0, 1).astype(np.float64), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def by_fold(scored: DataFrame, fold: Column, least: float = 0.5) -> DataFrame:
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
