"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt into cells of about `cell` pieces, whatever
their documents, and each cell is packed on several islands (rows of a DataFrame, so tasks of their own). An individual is
a set of bins. Crossover injects well-filled bins of one parent whole into the other and drops the bins that now hold
duplicates; of the pieces displaced, those that fill a bin to the brim in place of a smaller piece are exchanged for it, and
the rest is best-fitted. After each epoch all islands of a cell receive one another's elites; the best individual of the
last epoch counts. A cell whose bins are as few as a lower bound allows is settled and leaves the epochs; the others go on.
Pieces in bins with much room left are then dealt and packed once more across cells.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often as they occur; an empty table
gives an empty table; other columns are not read. A cell holds a bounded number of pieces, never all of one document.
"""

from __future__ import annotations

import heapq
import operator
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import discard, materialise, rows_of, sole
from tierwalk.llm.tokens import encoder

CAPACITY = 2048
CELL, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 3, 4, 6, 12
#: A bin with this share free takes part in the second round.
ROOM = 1 / 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity if there are several."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """PIECE rows of every document."""
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = sole(encoder(path))
        for batch in rows_of(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + mark
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


class Bins:
    """An individual: bins as lists of piece numbers, with the room left in each."""

    def __init__(self, lengths: list[int], capacity: int, held: list[list[int]] | None = None, room: list[int] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.held: list[list[int]] = held or []
        self.room: list[int] = [capacity - sum(map(lengths.__getitem__, h)) for h in self.held] if room is None else room
        self.known: tuple[int, int] | None = None
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if a bin has room r
        for at, room in enumerate(self.room):
            self._offer(at, room)

    def _offer(self, at: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(at)
        self.rooms |= 1 << room

    def fit(self, items: list[int]) -> None:
        """Best fit in the order given: into the bin that is left with the least room, else into a new one."""
        lengths, self.known = self.lengths, None
        for i in items:
            n = lengths[i]
            fitting = self.rooms >> n
            if not fitting:
                self.held.append([i])
                self.room.append(self.capacity - n)
                self._offer(len(self.held) - 1, self.capacity - n)
                continue
            r = n + (fitting & -fitting).bit_length() - 1
            stack = self.by_room[r]
            at = stack.pop()
            if not stack:
                self.rooms &= ~(1 << r)
            self.held[at].append(i)
            self.room[at] = r - n
            self._offer(at, r - n)

    def merit(self) -> tuple[int, int]:
        """Fewer bins first, then unevenly filled ones: room gathered in few bins can be used."""
        if self.known is None:
            self.known = len(self.held), -sum(map(operator.mul, self.room, self.room))
        return self.known


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The most, over k, of what pieces above capacity - k, above half, and from k to half need together."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, 0
    for k in range(half + 1):
        over, large = n[-1] - n[capacity - k], n[capacity - k] - n[half]
        small, wide = total[half] - (total[k - 1] if k else 0), total[capacity - k] - total[half]
        best = max(best, int(over + large + max(0, -(-int(small - (large * capacity - wide)) // capacity))))
    return best


def filled(held: list[list[int]], room: list[int], loose: list[int], lengths: list[int], capacity: int) -> Bins:
    """Bins (and the room in each) in which loose pieces stand in for smaller ones where they fill a bin to the brim; the rest is best-fitted."""
    wanted: dict[int, list[tuple[int, int]]] = {}  # by the length that would fill the bin in a piece's place
    for b, r in enumerate(room):
        if r:
            for i in held[b]:
                wanted.setdefault(lengths[i] + r, []).append((b, i))
    queue, rest = [(-lengths[i], i) for i in loose], []
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        places = wanted.get(-n)
        while places:
            b, j = places.pop()
            if room[b] and lengths[j] + room[b] == -n and j in held[b]:
                held[b] = [i if x == j else x for x in held[b]]
                room[b] = 0
                heapq.heappush(queue, (-lengths[j], j))
                break
        else:
            rest.append(i)
    bins = Bins(lengths, capacity, held, room)
    bins.fit(rest)
    return bins


def cross(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """A child of a with some of b's well-filled bins."""
    full = sorted(range(len(b.held)), key=b.room.__getitem__)[: max(1, len(b.held) * 2 // 3)]
    chosen = rng.sample(full, max(1, len(full) // 3))
    held, room = [b.held[k] for k in chosen], [b.room[k] for k in chosen]
    taken = {i for h in held for i in h}
    loose: list[int] = []
    for h, r in zip(a.held, a.room, strict=True):
        if taken.isdisjoint(h):
            held.append(h)
            room.append(r)
        else:
            loose += [i for i in h if i not in taken]
    return filled([list(h) for h in held], room, loose, a.lengths, a.capacity)


def shaken(a: Bins, rng: random.Random) -> Bins:
    """A mutant: the roomiest bins and a few others are dissolved and their pieces placed anew."""
    order = sorted(range(len(a.held)), key=lambda k: -a.room[k])
    gone = {*order[: max(1, len(order) // 50)], *rng.sample(order, max(1, len(order) // 25))}
    stay = [k for k in range(len(order)) if k not in gone]
    return filled([list(a.held[k]) for k in stay], [a.room[k] for k in stay], [i for k in gone for i in a.held[k]], a.lengths, a.capacity)


def evolve(lengths: list[int], capacity: int, elites: list[list[int]], seed: int, population: int, children: int) -> tuple[list[int], bool]:
    """The bin of each piece in the best individual after one epoch, and whether it is at the bound; elites come from all islands."""
    rng, bound, pool = random.Random(seed), lower_bound(lengths, capacity), []
    for genome in elites:
        groups: dict[int, list[int]] = {}
        for i, g in enumerate(genome):
            groups.setdefault(g, []).append(i)
        pool.append(Bins(lengths, capacity, list(groups.values())))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while len(pool) < population and not any(len(x.held) <= bound for x in pool):
        bins, noise = Bins(lengths, capacity), capacity / 20 if pool else 0
        bins.fit(sorted(order, key=lambda i: -lengths[i] + rng.uniform(-noise, noise)) if noise else order)
        pool.append(bins)
    pool.sort(key=Bins.merit)
    for _ in range(children):
        if len(pool[0].held) <= bound:
            break
        # Better parents come up more often; the child displaces the worst, unless it is no better or as good as another.
        a, b = (min(rng.sample(range(len(pool)), 2)) for _ in range(2)) if len(pool) > 1 else (0, 0)
        child = cross(pool[a], pool[b], rng) if a != b else shaken(pool[a], rng)
        if a != b and rng.random() < 0.5:
            child = shaken(child, rng)
        if child.merit() < pool[-1].merit() and all(child.merit() != x.merit() for x in pool):
            pool[-1] = child
            pool.sort(key=Bins.merit)
    genome = [0] * len(lengths)
    for g, held in enumerate(pool[0].held):
        for i in held:
            genome[i] = g
    return genome, len(pool[0].held) <= bound


def _cells(items: DataFrame, cell: int) -> DataFrame:
    """(cell, items): rows dealt by a hash of their place, so that no document or length can crowd a cell."""
    n = max(1, -(-items.count() // cell))
    dealt = items.withColumn("cell", F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {n})"))
    return dealt.groupBy("cell").agg(F.collect_list(F.struct(*items.columns)).alias("items"))


def _round(items: DataFrame, capacity: int, cell: int, islands: int, epochs: int, population: int, children: int, first: int) -> DataFrame:
    """The items with (sequence_id, place, used): place is the order within the sequence, used its tokens."""
    spread = max(8, items.sparkSession.sparkContext.defaultParallelism)
    cells = materialise(_cells(items, cell), "cells")
    lengths = cells.select("cell", F.expr("transform(items, x -> int(x.length))").alias("lengths"))
    schema = "cell long, island int, genome array<int>, settled boolean"

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            genome, settled = evolve(row["lengths"], capacity, row["elites"], hash((row["cell"], row["island"], row["epoch"])), population, children)
            columns = [pa.array([row["cell"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([genome], pa.list_(pa.int32())), pa.array([settled])]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "island", "genome", "settled"])

    done, going = None, lengths.withColumn("elites", F.expr("cast(array() as array<array<int>>)"))
    for i in range(epochs):
        on = going.select("cell", "lengths", "elites", F.lit(i).alias("epoch"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        grown = on.repartition(spread, "cell", "island").mapInArrow(epoch, schema)
        best = grown.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("island", "genome"))).alias("grown"), F.max("settled").alias("settled"))
        best = materialise(best.select("cell", F.expr("transform(grown, x -> x.genome)").alias("elites"), "settled"), f"epoch{i}")
        now = best.drop("settled") if i == epochs - 1 else best.where("settled").drop("settled")
        done = now if done is None else done.union(now)
        going = lengths.join(best.where("not settled").drop("settled"), "cell")
        if best.where("not settled").isEmpty():
            break
    state = cells.join(done, "cell")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            lengths = [x["length"] for x in row["items"]]

            def merit(genome: list[int], lengths: list[int] = lengths) -> tuple[int, int]:
                rooms = capacity - np.bincount(genome, lengths)
                return len(rooms), -int(rooms @ rooms)

            genome = min(row["elites"], key=merit)
            used = np.bincount(genome, lengths).astype(int).tolist()
            at = [0] * len(used)
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used")}
            for item, g in zip(row["items"], genome, strict=True):
                for k, v in item.items():
                    out[k].append(v)
                out["sequence_id"].append((first << 60) + (row["cell"] << 24) + g)
                out["offset"].append(at[g])
                out["used"].append(used[g])
                at[g] += item["length"]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], names=list(out))

    return state.repartition(spread, "cell").select("cell", "items", "elites").mapInArrow(settle, PIECE + ", sequence_id long, offset long, used long")


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, children: int = CHILDREN, room: float = ROOM) -> DataFrame:
    """PIECE rows with sequence_id and offset."""
    items = materialise(items, "pieces")
    first = materialise(_round(items, capacity, cell, islands, epochs, population, children, 0), "packed")
    discard(items)
    roomy = F.col("used") <= int(capacity * (1 - room))
    again = _round(first.where(roomy).select(*items.columns), capacity, cell, islands, epochs, population, children, 1)
    return first.where(~roomy).unionByName(again).drop("used")
