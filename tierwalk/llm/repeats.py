"""Removal of repeated passages by automata of repeated phrases.

A window is `width` consecutive words of one document. Equal windows contain the same least phrase of `PHRASE` words (by
hash, leftmost of ties), so a window can only recur if that phrase does.

0. Rows whose text also stands under a smaller id lose all windows at once; the others go on.
1. Each document names its windows' least phrases; phrases counted twice or more recur.
2. Documents are dealt to shards. Each shard hashes its windows of recurring phrases (96 bits); hashes counted twice or more
   over all shards confirm a recurring passage, with the first place where it stands.
3. Each shard compiles the phrases of the confirmed passages it holds into an Aho-Corasick automaton over words and streams
   all its documents through it. Where a phrase occurs, the passages around it are compared word by word (by hash); those
   that stand and also start earlier are dropped. Nothing else marks a word.

A shard holds about `shard_bytes` of text. What a shard learns about a passage is one row, however often its documents hold
it; a phrase is one row for each place of it. Counts are combined before they are shuffled, and every join on a phrase or a
passage has plain shuffles on both sides, so that adaptive execution can split a very common one.

Edge cases: null and empty texts have no words; texts shorter than a window stay whole; a row repeated under the same id
does not come before itself, so it stays; one id with several texts is one document whose texts all start at word 0; rows
without an id come after all others; an empty table gives an empty table; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import U64, WordIds, discard, materialise, mix, rolling, rows_of

WIDTH, PHRASE = 20, 10
SHARD_BYTES = 5_000_000
#: Copied texts whose hashes may be broadcast; more are joined by a shuffle.
MOST_SENT = 1_000_000
LAST = np.iinfo(np.int64).max
_WORDS = WordIds()
WINDOWS = "shard int, w1 long, w2 int, at long, key long, start int, n int"
_WINDOWS = pa.schema([("shard", pa.int32()), ("w1", pa.int64()), ("w2", pa.int32()), ("at", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def least_phrases(hashes: np.ndarray, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each window the place of its least one (leftmost of ties)."""
    g = mix(rolling(hashes, phrase))
    if len(hashes) < width:
        return g, np.empty(0, np.int64)
    span = width - phrase + 1
    n = len(g) - span + 1
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = g[j : j + n] < best
        np.copyto(best, g[j : j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    return g, at


def windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each window's words."""
    return mix(rolling(hashes, width)), (mix(rolling(mix(hashes ^ U64(0x5851F42D4C957F2D)), width, 0xD1342543DE82EF95)) >> U64(32)).astype(np.uint32)


class Words:
    """Texts as one run of word hashes; 0 stands after each text."""

    def __init__(self, found: list[bytes]):
        self.words = [t.split() for t in found]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.hashes = np.zeros(int(lengths.sum()) + len(lengths), U64)
        for s, words in zip(self.first.tolist(), self.words, strict=True):
            self.hashes[s : s + len(words)] = _WORDS.of(words)
        self.number = np.repeat(np.arange(len(lengths)), lengths + 1)

    def valid(self, width: int) -> np.ndarray:
        """Whether a window can start at each place: the word `width - 1` on belongs to the same text."""
        n = len(self.hashes) - width + 1
        return (self.number[:n] == self.number[width - 1 :]) & (self.hashes[width - 1 :] > 0) if n > 0 else np.empty(0, bool)

    def least(self, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all phrases, and the places of those that are the least of a window."""
        ok = self.valid(width)
        if not ok.any():
            return np.empty(0, U64), np.empty(0, np.int64)
        g, at = least_phrases(self.hashes, width, phrase)
        at = at[ok]
        return g, np.unique(at[np.concatenate(([True], at[1:] != at[:-1]))])


def _phrases(docs: DataFrame, width: int, phrase: int, bits: int) -> DataFrame:
    """(shard, h): one row for each place of a least phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            w = Words([t or b"" for t in batch.column(1).to_pylist()])
            g, at = w.least(width, phrase)
            shard = batch.column(0).to_numpy()[w.number[at]]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array((g[at] >> U64(64 - bits)).view(np.int64))], names=["shard", "h"])

    return docs.select("shard", "text").mapInArrow(run, "shard int, h long")


DIGITS = 6  # bits of a letter that a word's number is written in


class Shard(Words):
    """Documents of one shard; `key` tells texts of one id apart."""

    def __init__(self, docs: pa.Table):
        super().__init__([t or b"" for t in docs.column("text").to_pylist()])
        self.ids = np.array([LAST if i is None else i for i in docs.column("doc_id").to_pylist()], np.int64)
        self.keys = docs.column("key").to_numpy()

    def letters(self, phrases: np.ndarray, phrase: int) -> tuple[str, int, np.ndarray]:
        """Runs of words that all stand in phrases (which start at these places), in so many letters a word, and the place of each word.

        Nodes of the automaton then have few branches. A phrase cannot occur elsewhere; runs shorter than one are left out, and
        after each run stands the word that ends it, in letters that no phrase has.
        """
        _, number = np.unique(self.hashes, return_inverse=True)
        used = np.zeros(int(number.max(initial=0)) + 1, bool)
        for j in range(phrase):
            used[number[phrases + j]] = True
        number, inside = (np.cumsum(used) - 1)[number], used[number]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= phrase
        start, n = start[long], (end - start)[long] + 1
        place = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        size = max(1, -(-int(used.sum()).bit_length() // DIGITS))
        letters = (((number[place][:, None] >> np.arange(size) * DIGITS) & ((1 << DIGITS) - 1)) + 48).astype(np.uint8)
        letters[np.cumsum(n) - 1] = 47
        return letters.tobytes().decode("latin-1"), size, place

    def candidates(self, recurring: np.ndarray, width: int, phrase: int, bits: int) -> np.ndarray:
        """Places of the windows whose least phrase recurs."""
        ok = np.flatnonzero(self.valid(width))
        if not len(ok) or not len(recurring):
            return np.empty(0, np.int64)
        g, at = least_phrases(self.hashes, width, phrase)
        return ok[np.isin((g[at[ok]] >> U64(64 - bits)).view(np.int64), recurring)]

    def places(self, known: pa.Table) -> np.ndarray:
        """Where each known passage stands in this shard, by its document and start."""
        row = {k: i for i, k in enumerate(zip(self.ids.tolist(), self.keys.tolist(), strict=True))}
        mine = np.fromiter(map(row.__getitem__, zip(known.column("at").to_pylist(), known.column("key").to_pylist(), strict=True)), np.int64, known.num_rows)
        return self.first[mine] + known.column("start").to_numpy()


class Passages:
    """Confirmed passages of a shard behind an automaton of their least phrases."""

    def __init__(self, s: Shard, at: np.ndarray, width: int, phrase: int):
        import ahocorasick

        self.shard, self.width, self.phrase = s, width, phrase
        g = mix(rolling(s.hashes, phrase))
        inside = np.lib.stride_tricks.sliding_window_view(g, width - phrase + 1)[at].argmin(axis=1)
        _, one, group = np.unique(g[at + inside], return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        #: Passages by phrase: which, how far before the phrase each starts, and where each phrase's begin.
        self.which, self.before = order, inside[order]
        self.begin = np.searchsorted(group[order], np.arange(len(one) + 1))
        self.at = at
        phrases = (at + inside)[one]
        self.text, self.size, self.place = s.letters(phrases, phrase)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate((np.searchsorted(self.place, phrases) * self.size).tolist()):
            self.automaton.add_word(self.text[p : p + phrase * self.size], i)
        self.automaton.make_automaton()

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, passage) of every occurrence in the shard's documents."""
        found = np.array(list(self.automaton.iter(self.text)) if len(self.automaton) else [], np.int64).reshape(-1, 2)
        starts, group = found[:, 0] + 1 - self.phrase * self.size, found[:, 1]
        whole = starts % self.size == 0
        starts, group = self.place[starts[whole] // self.size], group[whole]
        n = np.diff(self.begin)[group]
        # All passages of each phrase that occurred: the k-th of the n of a hit.
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(self.begin[group], n) + k
        place, passage = np.repeat(starts, n) - self.before[slot], self.which[slot]
        w1, w2 = windows(self.shard.hashes, self.width)
        ok = self.shard.valid(self.width)
        inside = (place >= 0) & (place < len(ok))
        place, passage = place[inside], passage[inside]
        there = self.at[passage]
        same = ok[place] & (w1[place] == w1[there]) & (w2[place] == w2[there])
        return place[same], passage[same]


def _hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _confirm(width: int, phrase: int, bits: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        """One row for each distinct window of a recurring phrase in a shard: its first place here, and 2 if there are more."""
        if not docs.num_rows or not told.num_rows:
            return _WINDOWS.empty_table()
        s = Shard(docs)
        at = s.candidates(told.column("h").to_numpy(), width, phrase, bits)
        w1, w2 = (w[at] if len(at) else w[:0] for w in windows(s.hashes, width))
        row = s.number[at]
        doc, start = s.ids[row], at - s.first[row]
        order = np.lexsort((start, doc, w2, w1))
        w1, w2, doc, start, key = w1[order], w2[order], doc[order], start[order], s.keys[row][order]
        new = np.ones(len(at), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        n = np.minimum(np.diff(np.concatenate((np.flatnonzero(new), [len(w1)]))), 2)
        columns = [np.full(len(n), docs.column("shard")[0].as_py()), w1[new].view(np.int64), w2[new].view(np.int32), doc[new], key[new], start[new], n]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WINDOWS, strict=True)], schema=_WINDOWS)

    return run


def marks(s: Shard, known: pa.Table, width: int, phrase: int) -> np.ndarray:
    """For each word of the shard whether an occurrence of a known passage that also starts earlier covers it."""
    gone = np.zeros(len(s.hashes) + 1, np.int64)
    if known.num_rows:
        place, passage = Passages(s, s.places(known), width, phrase).occurrences()
        doc, start = s.ids[s.number[place]], place - s.first[s.number[place]]
        d, b = known.column("first_at").to_numpy()[passage], known.column("first_start").to_numpy()[passage]
        later = place[(doc > d) | (doc == d) & (start > b)]
        gone += np.bincount(later, minlength=len(gone)) - np.bincount(later + width, minlength=len(gone))
    return np.cumsum(gone) > 0


def _drop(width: int, phrase: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _DIGEST.empty_table()
        s = Shard(docs)
        gone = marks(s, known, width, phrase)
        rows = []
        for i, f, words in zip(docs.column("doc_id").to_pylist(), s.first.tolist(), s.words, strict=True):
            mine = gone[f : f + len(words)]
            kept = [w for w, x in zip(words, mine.tolist(), strict=True) if not x] if mine.any() else words
            rows.append((i, len(words), len(words) - len(kept), _hash(kept)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    return run


def _gone(copies: DataFrame, width: int) -> DataFrame:
    """DIGEST of copies: nothing stays of a text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            words = [t.split() for t in batch.column(1).to_pylist()]
            kept = [[] if len(w) >= width else w for w in words]
            columns = [[len(w) for w in words], [len(w) - len(x) for w, x in zip(words, kept, strict=True)], [_hash(x) for x in kept]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_DIGEST)[1:], strict=True))], schema=_DIGEST)

    return copies.select("doc_id", "text").mapInArrow(run, DIGEST)


def _first_copies(base: DataFrame) -> DataFrame:
    """(sum, least): the smallest id of each text that stands under several; counted in part before the shuffle."""
    held = base.select("sum", "doc_id").where("doc_id is not null and sum is not null")
    return held.groupBy("sum").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("sum", "least")


def remove(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """DIGEST of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    # Of a phrase's hash so many bits go round that chance makes few phrases equal: those only cost a look.
    bits = min(63, max(24, size.bit_length() + 6))
    base = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("sum", F.unhex(F.md5("text")))
    first = materialise(_first_copies(base), "copies")
    if first.count() <= MOST_SENT:
        base = base.join(F.broadcast(first), "sum", "left")
    else:
        # Ids meet the hashes without their texts; the pairs found are spread evenly.
        later = base.select("sum", "doc_id").distinct().join(first, "sum").where("doc_id > least")
        base = base.join(later, ["sum", "doc_id"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    gone = _gone(base.where(copy), width)
    base = base.where(~copy).select("doc_id", "text", F.xxhash64("text").alias("key")).withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, key), {n}) as int)"))
    phrases = materialise(_phrases(base, width, phrase, bits), "places")
    # Written first, so that the join has plain shuffles on both sides and a very common phrase can be split.
    recurring = materialise(phrases.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "recurring")
    told = materialise(phrases.join(recurring, "h").select("shard", "h"), "told")
    discard(phrases, recurring)
    found = materialise(base.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_confirm(width, phrase, bits), WINDOWS), "windows")
    discard(told)
    passages = found.groupBy("w1", "w2").agg(F.sum("n").alias("all"), F.min(F.struct("at", "start")).alias("first")).where("all > 1")
    passages = materialise(passages.selectExpr("w1", "w2", "first.at as first_at", "first.start as first_start"), "passages")
    # A shard whose only copy is the first one has nothing to remove for it.
    known = found.join(passages, ["w1", "w2"]).where("not (n = 1 and first_at = at and first_start = start)").select("shard", "at", "key", "start", "first_at", "first_start")
    dropped = base.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_drop(width, phrase), DIGEST)
    return dropped.unionByName(gone)
