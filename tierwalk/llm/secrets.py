"""Secrets in texts: patterns propose findings, a random forest removes false ones.

Features of a finding: length, character classes and their transitions, how unlikely its letter transitions are for a word,
entropy, how much of it dictionary words cover, known prefixes, the kind of pattern, and the words and path on both sides of
it. Dictionary and letter transitions come from a public vocabulary (`Lexicon.read`). The forest is grown in numpy from
labelled findings (`fit`); `labelled_findings` writes some by rule with a fixed seed: keys, tokens and passwords as real ones
look, against placeholders, digests, identifiers, versions, paths and numbers in the places where they stand.

Edge cases: null and empty texts have no findings; equal texts have equal findings; overlapping findings of several
patterns count once, the first pattern's; values have no upper length; an empty table gives an empty table; other columns
are not read. Values do not leave the operator unless asked for: a finding carries a hash of its value.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierwalk.llm.common import rows_of

#: Fixed formats of issued keys, then what is assigned to a telling name, then any long token. Values have no upper length:
#: loops over one class of characters are possessive and start once a run, so that a text is read in linear time. A private
#: key without an end mark goes on after 8,000 characters only while it looks like a key.
PATTERNS = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+(?=-----END)|[^-]{0,8000}+[A-Za-z0-9+/=\r\n]*+)")),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("issued_token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})")),
    ("web_token", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    ("assigned", re.compile(r"(?i:passw(?:or)?d|pwd|secret|token|api_?key|access_?key|auth|credential)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([^\s\"']{6,}+)")),
    ("opaque", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_-])")),
)
ASSIGN = re.compile("[:=]")
LONG = re.compile(r"[A-Za-z0-9+/_-]{20}|eyJ|xox|-----B")
#: Characters on each side of a value that are looked at.
REACH = 60
LETTERS = {c: i for i, c in enumerate(string.ascii_lowercase)}
HINTS = {
    "telling": ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login"),
    "harmless": ("example", "sample", "dummy", "placeholder", "test", "fake", "your", "xxxx", "changeme", "todo", "mock"),
    "digest": ("sha1", "sha256", "sha512", "md5", "checksum", "digest", "commit", "hash", "uuid", "etag", "integrity"),
}
OUT = "doc_id long, kind string, start long, end long, value_sha256 string, score double, secret boolean"


@dataclass(frozen=True, eq=False)
class Lexicon:
    """Words of four letters and more, and how surprising each step from letter to letter is within them (in bits)."""

    words: frozenset[str]
    steps: np.ndarray  # 27 x 27, the last for whatever is no letter
    longest: int = 14

    @staticmethod
    def of(words: Iterable[str]) -> Lexicon:
        held = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())
        counts = np.full((27, 27), 0.1)
        for w in sorted(held):
            for x, y in zip(w, w[1:], strict=False):
                counts[LETTERS[x], LETTERS[y]] += 1
        return Lexicon(held, -np.log2(counts / counts.sum(axis=1, keepdims=True)))

    @staticmethod
    @cache
    def read(path: str) -> Lexicon:
        """The whole words of a tokenizer's file: entries that start a word."""
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        return Lexicon.of(t[1:].lower() for t in vocabulary if t[:1] in "\u0120\u2581")

    def covered(self, value: str) -> int:
        """Letters of the value that words cover, the longest word from each place first."""
        total = 0
        for run in re.findall("[a-z]{4,}", value):
            i = 0
            while i < len(run) - 3:
                n = next((n for n in range(min(self.longest, len(run) - i), 3, -1) if run[i : i + n] in self.words), 0)
                total += n
                i += n or 1
        return total

    def surprise(self, value: str) -> float:
        """Mean surprise of the value's steps."""
        at = np.fromiter((LETTERS.get(c, 26) for c in value), np.int64, len(value))
        return float(self.steps[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0


def propose(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates, in order, without overlaps."""
    if not (ASSIGN.search(text) or LONG.search(text)):
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        held, at, new = found, 0, []
        for m in pattern.finditer(text):
            s, e = m.span(1 if pattern.groups else 0)
            # Both lists are in order and free of overlaps, so one walk along `held` finds what a match could touch.
            while at < len(held) and held[at][1] <= s:
                at += 1
            if at == len(held) or e <= held[at][0]:
                new.append((s, e, kind))
        found = sorted(found + new) if new else found
    return found


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


PATH = re.compile(r"[\w.-]*/[\w./-]*|\b[\w-]+\.(?:py|js|ts|md|txt|ya?ml|json|env|cfg|ini|lock|toml|pem|sh)\b")


def features(value: str, kind: str, before: str, after: str, lexicon: Lexicon) -> list[float]:
    """`before` and `after` are what stands around the value, up to REACH characters."""
    n = len(value)
    classes = [_class(c) for c in value]
    counts = [classes.count(k) / n for k in range(4)]
    steps = Counter(zip(classes, classes[1:], strict=False))
    changes = sum(v for (a, b), v in steps.items() if a != b) / max(n - 1, 1)
    tally = Counter(value)
    entropy = -sum(v / n * math.log2(v / n) for v in tally.values())
    near, whole = before.lower(), value.lower()
    far = after.lower()
    return [
        math.log(n),
        *counts,
        changes,
        steps[(2, 0)] / n + steps[(0, 2)] / n,
        steps[(0, 1)] / n + steps[(1, 0)] / n,
        lexicon.surprise(whole),
        lexicon.surprise("".join(c for c in whole if c in LETTERS)),
        entropy,
        entropy / max(math.log2(n), 1),
        lexicon.covered(whole) / n,
        max(tally.values()) / n,
        max((len(x) for x in re.findall(r"[a-z]+", whole)), default=0) / n,
        float(all(c in string.hexdigits for c in value)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", whole))),
        float(value[:4] in ("AKIA", "ASIA", "ghp_", "xoxb", "AIza", "sk_l")),
        *(float(any(w in near for w in HINTS[h])) for h in HINTS),
        *(float(any(w in far for w in HINTS[h])) for h in HINTS),
        float(any(w in whole for w in HINTS["harmless"])),
        float(bool(re.search(r"[\w\"'][ \t]*[:=][ \t]*[\"']?$", before))),
        float(bool(PATH.search(before))),
        float(bool(PATH.search(after))),
        float(value.count("/") + value.count("-") + value.count("_")) / n,
        float([k for k, _ in PATTERNS].index(kind)),
    ]


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(value, kind, before, after, 1 if a secret)."""
    rng = random.Random(seed)
    syllables = ("the", "an", "er", "in", "con", "ter", "ing", "ver", "data", "user", "file", "name", "ment", "port", "load", "set", "ion", "al", "re", "st", "max", "id", "get", "list")
    hexes, base62 = "0123456789abcdef", string.ascii_letters + string.digits

    def some(letters: str, low: int, high: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def word(low: int = 1, high: int = 3) -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(low, high)))

    def prose() -> str:
        return " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice(("", " ", ".\n", ": "))

    def name(telling: bool) -> str:
        return rng.choice(HINTS["telling"] if telling else ("version", "id", "path", "ref", "name", "build")) + rng.choice(("=", " = ", ": ", '="', ' = "', '": "'))

    def later(digest: bool = False) -> str:
        said = (" is the sha256 of the file", " as checksum", " in the commit", " (md5)") if digest and rng.random() < 0.5 else ()
        return rng.choice(said or ("", '"', " ", "\n", ". ", " in src/" + word() + "/" + word() + ".py", ", ")) + prose()

    out = []
    for _ in range(n // 2):
        r = rng.random()
        if r < 0.15:
            out.append((rng.choice(("AKIA", "ASIA")) + some(string.ascii_uppercase + string.digits, 16, 16), "access_key", rng.choice((prose(), prose() + name(True))), 1))
        elif r < 0.25:
            out.append((rng.choice(("ghp_", "xoxb-", "sk_live_", "AIza")) + some(base62, 35, 36), "issued_token", prose() + rng.choice(("", name(True))), 1))
        elif r < 0.3:
            out.append(("-----BEGIN RSA PRIVATE KEY-----\n" + some(base62 + "+/", 200, 800), "private_key", prose(), 1))
        elif r < 0.35:
            out.append(("eyJ" + some(base62, 20, 60) + "." + some(base62, 40, 120) + "." + some(base62 + "-_", 30, 50), "web_token", prose() + rng.choice(("", "Bearer ")), 1))
        elif r < 0.85:
            value = rng.choice((some(hexes, 12, 64), some(base62, 10, 48), some(base62 + "!@#$%^&*", 8, 20), some(base62 + "+/", 38, 42)))
            out.append((value, "assigned", prose() + name(True), 1))
        else:
            out.append((some(base62 + "+/", 32, 64), "opaque", prose() + rng.choice(("", name(True))), 1))
    for _ in range(n - n // 2):
        r = rng.random()
        if r < 0.2:
            value = rng.choice(("your_" + word() + "_key", "xxxxxxxx" + "x" * rng.randint(0, 20), "changeme" + some(string.digits, 0, 3), "<" + word() + ">", "${" + word().upper() + "}", "example-" + word(), "os.environ[" + word(), "None,", "function(" + word() + ")", "*" * rng.randint(6, 12)))
            out.append((value, "assigned", prose() + name(True), 0))
        elif r < 0.4:
            out.append((word(2, 4) + rng.choice((",", ".", ";", "()", "")), "assigned", prose() + name(True), 0))
        elif r < 0.55:
            out.append((some(hexes, 40, 64), "opaque", prose() + (rng.choice(HINTS["digest"]) + rng.choice((" ", ": ", "=", "-")) if rng.random() < 0.7 else ""), 0))
        elif r < 0.65:
            h = some(hexes, 32, 32)
            out.append(("-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), "opaque", prose() + rng.choice(("", "uuid ", name(False))), 0))
        elif r < 0.8:
            out.append((rng.choice("_-/").join(word() for _ in range(rng.randint(4, 8))) + some(string.digits, 1, 4), "opaque", prose() + rng.choice(("", name(False), "src/")), 0))
        elif r < 0.9:
            out.append((some(string.digits + "-", 24, 40), "opaque", prose(), 0))
        else:
            out.append((rng.choice(string.ascii_letters) * rng.randint(24, 40) + some(string.digits, 1, 2), "opaque", prose(), 0))
    return [(value, kind, before, later(not label and kind == "opaque"), label) for value, kind, before, label in out]


@dataclass
class Forest:
    """Trees as arrays: the feature asked (-1 at a leaf), the threshold, the two children, the share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = child[node, (x[rows, feature[node]] > cut[node]).astype(np.int64)]
            total += share[at]
        return total / len(self.trees)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes: list[list] = []
    tries = max(2, int(x.shape[1] ** 0.5) + 1)

    def node(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        p = y[rows].mean()
        nodes.append([-1, 0.0, (0, 0), p])
        if left == 0 or len(rows) < 2 * least or p in (0.0, 1.0):
            return me
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
            rest = len(t) - n
            gain = p * (1 - p) - (ones * (1 - ones / n) + (t.sum() - ones) * (1 - (t.sum() - ones) / rest)) / len(t)
            gain[(v[1:] == v[:-1]) | (n < least) | (rest < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float(v[k]))
        if best[1] >= 0:
            side = x[rows, best[1]] > best[2]
            nodes[me][:3] = [best[1], best[2], (node(rows[~side], left - 1), node(rows[side], left - 1))]
        return me

    node(rng.integers(0, len(y), len(y)), depth)
    return np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])


def fit(rows: Sequence[tuple[str, str, str, str, int]], lexicon: Lexicon, trees: int = 40, depth: int = 12, least: int = 3, seed: int = 9) -> Forest:
    """From findings as `labelled_findings` has them."""
    x, y = np.array([features(*row[:4], lexicon) for row in rows]), np.array([float(row[4]) for row in rows])
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y, rng, depth, least) for _ in range(trees)])


@cache
def forest(lexicon: Lexicon) -> Forest:
    return fit(labelled_findings(), lexicon)


def scan(docs: DataFrame, lexicon: Lexicon, model: Forest | None = None, least: float = 0.5) -> DataFrame:
    """OUT: one row per finding; `secret` where the forest's score is at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model or forest(lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
        words, trees = sent.value
        for batch in rows_of(batches):
            rows, x = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, e, kind in propose(text or ""):
                    x.append(features(text[s:e], kind, text[max(0, s - REACH) : s], text[e : e + REACH], words))
                    rows.append((doc, kind, s, e, hashlib.sha256(text[s:e].encode()).hexdigest()))
            if rows:
                score = trees.score(np.array(x))
                columns = [*zip(*rows, strict=True), score, score >= least]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
