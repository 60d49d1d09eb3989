"""Benchmark passages in documents, found by a generalised suffix automaton of the benchmark's words.

An automaton is built on the driver from at most `SHARD_WORDS` benchmark words (or one item) and sent to the tasks as
arrays: at most two states and three steps a word, below 100 bytes a word with its dictionary. A larger benchmark becomes
several automata. At most `HELD_WORDS` words' automata are alive at once, in the driver and in each worker; beyond that,
documents stream through one such set after another, with what was found so far written in between.

A window is `width` consecutive words of an item, or a whole item of fewer words. While a document's words stream
through the automaton, the longest match that ends at each word is tracked; a match of `width` words or more, or one that
ends with a whole short item, marks its words as hit and names the items.

`clean` judges a document as it came: by items and by the share of its words that are hit. Where it only cuts, words on both
sides of a cut become neighbours; the text is searched and cut again until no window is left.

Edge cases: null and empty texts have no words and no hits; an empty benchmark hits nothing; items without words or id are
ignored; repeated items each count under their own id; an empty table gives an empty table; columns besides the id and the
text are not read, and pass through `clean` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import materialise, rows_of

WIDTH = 8
SHARD_WORDS, HELD_WORDS = 100_000, 2_000_000
#: Bytes of words, after lower-casing A-Z: digits, a-z and all beyond ASCII; every other byte becomes a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "doc_id long, n_words long, n_hit long, max_match long, items array<long>, spans array<struct<s:int,e:int>>"
PAIR_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each state that a window ends in."""

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int = WIDTH):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = min([width, *(len(w) for _, w in items if w)])
        pairs = np.zeros(1 << PAIR_BITS, bool)
        ends: list[tuple[int, int, int]] = []
        for item, words in items:
            last, seq = 0, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for i, c in enumerate(seq):
                last = self._add(last, c)
                if i:
                    pairs[self._pair(seq[i - 1], c)] = True
                if i + 1 >= width or len(seq) < width and i + 1 == len(seq):
                    ends.append((last, min(width, len(seq)), item))
        self.pairs = pairs
        # The state of a window is the ancestor whose lengths include the window's.
        own: set[tuple[int, int, int]] = set()
        for state, n, item in ends:
            while self.len[self.link[state]] >= n and self.link[state] > 0:
                state = self.link[state]
            own.add((state, n, item))
        self._freeze(sorted(own))

    def _freeze(self, own: list[tuple[int, int, int]]) -> None:
        """Steps and windows as arrays in the order of their states; dictionaries go."""
        self.first = array("i", [0])
        self.words, self.to = array("i"), array("i")
        for state, steps in enumerate(self.next):
            for c, q in sorted(steps.items()):
                self.words.append(c)
                self.to.append(q)
            self.first.append(len(self.words))
            self.next[state] = None
        del self.next
        self.link, self.len = array("i", self.link), array("i", self.len)
        self.held = array("i", [state for state, _, _ in own])
        self.sizes, self.items = array("i", [n for _, n, _ in own]), array("q", [item for _, _, item in own])
        # The nearest suffix with windows of its own: visited by length, so suffixes come first.
        mine = set(self.held)
        self.near = array("i", bytes(4 * len(self.len)))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[v] = v if v in mine else self.near[self.link[v]]

    def step(self, state: int, c: int) -> int:
        """The state after c, or 0."""
        lo, hi = self.first[state], self.first[state + 1]
        if hi - lo == 1:
            return self.to[lo] if self.words[lo] == c else 0
        at = bisect_left(self.words, c, lo, hi)
        return self.to[at] if at < hi and self.words[at] == c else 0

    def windows(self, state: int) -> Iterator[tuple[int, int]]:
        """(size, item) of the windows that a state ends with."""
        state = self.near[state]
        while state:
            i = bisect_left(self.held, state)
            while i < len(self.held) and self.held[i] == state:
                yield self.sizes[i], self.items[i]
                i += 1
            state = self.near[self.link[state]]

    @staticmethod
    def _pair(a, b):
        return (a * 1_000_003 + b * 7919) & ((1 << PAIR_BITS) - 1)

    def _add(self, last: int, c: int) -> int:
        """Extend the automaton by c after `last`, also where an earlier item already has that path."""
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[int, set[int], list[tuple[int, int]]]:
        """Longest match (0 if shorter than any window), items, and hit runs of words (end exclusive)."""
        longest, items, spans = 0, set(), []
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        # Only runs whose neighbouring words also stand together in an item can hold a window; elsewhere matches stay short.
        if self.shortest > 1:
            joined = self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
            starts, stops = edge[::2], edge[1::2] + 1
            keep = stops - starts >= self.shortest
            runs = zip(starts[keep].tolist(), stops[keep].tolist(), strict=True)
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
            runs = zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
        step, link, length = self.step, self.link, self.len
        for start, stop in runs:
            v = n = 0
            for i, c in enumerate(ids[start:stop].tolist(), start):
                while v and not step(v, c):
                    v = link[v]
                    n = length[v]
                to = step(v, c)
                if to:
                    v, n = to, n + 1
                longest = max(longest, n)
                if n < self.shortest:
                    continue
                for size, item in self.windows(v):
                    if size <= n:
                        items.add(item)
                        s = i + 1 - size
                        if spans and spans[-1][1] >= s:
                            s = spans.pop()[0] if spans[-1][0] <= s else s
                            while spans and spans[-1][1] >= s:
                                s = min(s, spans.pop()[0])
                        spans.append((s, i + 1))
        return longest if longest >= self.shortest else 0, items, spans


def shards(benchmark: DataFrame, most: int = SHARD_WORDS, width: int = WIDTH, held_words: int = HELD_WORDS) -> Iterator[list[Automaton]]:
    """Sets of automata over the items in turn, of at most `held_words` words a set; an automaton has `most` words or one item."""
    group, in_group, held, n = [], 0, [], 0
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id")
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode("utf-8"))
        if not words:
            continue
        full = in_group and in_group + len(words) > held_words
        if held and (full or n + len(words) > most):
            group.append(Automaton(held, width))
            held, n = [], 0
        if full:
            yield group
            group, in_group = [], 0
        held.append((row.item_id, words))
        n, in_group = n + len(words), in_group + len(words)
    if held:
        group.append(Automaton(held, width))
    if group:
        yield group


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(automata: list[Automaton], words: list[bytes]) -> tuple[int, set[int], list[tuple[int, int]]]:
    """Longest match, items, and hit runs in order, of one document in several automata."""
    longest, items, spans = 0, set(), []
    for automaton in automata if words else ():
        most, own, at = automaton.scan(words)
        longest, items, spans = max(longest, most), items | own, spans + at
    return longest, items, merged(spans)


def _scanner(sent, last: bool):
    """Rows of SCHEMA from those before; the text goes on unless this is the last set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = []
            for doc, text, longest, items, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text or b"")
                most, own, at = _scan(sent.value, words)
                spans = merged([*((x["s"], x["e"]) for x in spans), *at])
                rows.append((doc, None if last else text, len(words), sum(e - s for s, e in spans), max(longest, most), sorted({*items, *own}), [{"s": s, "e": e} for s, e in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return scan


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.binary()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("max_match", pa.int64()),
        ("items", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
    ]
)


def _words_at_most(benchmark: DataFrame) -> int:
    """A bound on the benchmark's words: each takes a byte and one to part it from the next."""
    return (benchmark.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // 2 + 1


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, held_words: int = HELD_WORDS) -> DataFrame:
    """FOUND for each document: word counts, longest match, items that occur, hit runs of words."""
    send = docs.sparkSession.sparkContext.broadcast
    alone = _words_at_most(benchmark) <= held_words
    out = docs.selectExpr("doc_id", "cast(text as binary) as text", "0L as max_match", "cast(array() as array<long>) as items", "cast(array() as array<struct<s:int,e:int>>) as spans")
    before = None
    for group in shards(benchmark, shard_words, width, held_words):
        if before is not None:
            # Written before the next set is sent, so that two sets are never alive at once.
            out = materialise(out, "found").select("doc_id", "text", "max_match", "items", "spans")
            before.destroy()
        before = send(group)
        out = out.mapInArrow(_scanner(before, alone), "doc_id long, text binary," + FOUND.removeprefix("doc_id long,"))
    if before is None:
        out = out.mapInArrow(_scanner(send([]), True), "doc_id long, text binary," + FOUND.removeprefix("doc_id long,"))
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    items = "array_join(array_sort(transform(items, x -> string(x))), ',')"
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as bigint) n_items", f"sha2({items}, 256) items_sha256", "size(items) >= 2 contaminated")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; what stands between the words of a run goes with it."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def _cut_all(automata: list[Automaton], text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs, and without whatever windows their going makes."""
    while spans:
        text = cut(text, spans)
        _, _, spans = _scan(automata, words_of(text.encode()))
    return text


def clean(docs: DataFrame, benchmark: DataFrame, most_items: int = 2, most_cover: float = 0.5, shard_words: int = SHARD_WORDS, held_words: int = HELD_WORDS) -> DataFrame:
    """Rows without those that hold `most_items` items or of whose words over `most_cover` are hit; hit runs leave the others' texts."""
    if _words_at_most(benchmark) > held_words:
        return _clean_in_turn(docs, benchmark, most_items, most_cover, shard_words, held_words)
    sent = docs.sparkSession.sparkContext.broadcast(next(shards(benchmark, shard_words, held_words=held_words), []))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            kept, texts = [], []
            for i, text in enumerate(batch.column(place).to_pylist()):
                words = words_of((text or "").encode())
                _, items, spans = _scan(sent.value, words)
                if len(items) < most_items and sum(e - s for s, e in spans) <= most_cover * len(words):
                    kept.append(i)
                    texts.append(_cut_all(sent.value, text, spans) if spans else text)
            out = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, out.schema.field(j).type) if j == place else out.column(j) for j in range(out.num_columns)], schema=out.schema)

    return docs.mapInArrow(keep, docs.schema)


def _cuts(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, text, spans), runs cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [cut(t, [(x["s"], x["e"]) for x in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def _clean_in_turn(docs: DataFrame, benchmark: DataFrame, most_items: int, most_cover: float, shard_words: int, held_words: int) -> DataFrame:
    """The same for a benchmark of several sets: rows are numbered, judged over all sets, and cut until no set finds a window."""
    row = next(name for name in (f"row_{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = find(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, shard_words=shard_words, held_words=held_words)
    stay = materialise(found.where(f"size(items) < {most_items} and n_hit <= {most_cover} * n_words").select("doc_id", "spans"), "judged")
    whole = rows.join(stay.where("size(spans) = 0").select(F.col("doc_id").alias(row)), row, "left_semi")
    going, done = rows.select(F.col(row).alias("doc_id"), "text").join(stay.where("size(spans) > 0"), "doc_id"), None
    while True:
        texts = materialise(_cuts(going), "cut")
        left = materialise(find(texts, benchmark, shard_words=shard_words, held_words=held_words).where("n_hit > 0").select("doc_id", "spans"), "left")
        clear = texts.join(left, "doc_id", "left_anti")
        done = clear if done is None else done.unionByName(clear)
        if left.isEmpty():
            break
        going = texts.join(left, "doc_id")
    shorter = rows.drop("text").join(done.withColumnRenamed("doc_id", row), row)
    return whole.select(*docs.columns).unionByName(shorter.select(*docs.columns))


def items_hash(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
