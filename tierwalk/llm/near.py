"""Near-duplicate documents by b-bit MinHash.

A document's set holds the hashes of its distinct shingles. Documents with equal sets fold into one class first. Classes
meet in buckets, one for each band of minima. The low `B` bits of all minima, packed into 64-bit words, estimate the
similarity of a candidate pair by counting equal places and taking off chance collisions; pairs that could pass are
confirmed on their full sets.

Candidates never are all pairs of a bucket. In each of a few rounds, the members of a bucket are put in an order in which
like sketches stand together, large buckets in parts; of the neighbours found for a component the likeliest pair is
confirmed; links give components, and buckets of one component are finished. At the end, members of different components
that still share a bucket are compared in blocks of bounded size: sketches rule most pairs out, and sets decide on the
others unless they are connected by then. A block returns only links that connect, so no list of pairs is ever made.
What is left out are pairs that are already connected, so components are whole.

Edge cases: null and empty texts have an empty set and stay alone; a text of fewer words than a shingle is one shingle;
repeated rows each get a row and one class; where one id stands with several texts, each row goes with its text's class, and
a component is named by the smallest id in it; an empty table gives an empty table; columns besides the id and the text are
not read. Rows without an id get no component and link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.llm.common import U64, WordIds, discard, materialise, mix, release, rolling, rows_of, sole
from tierwalk.llm.components import components

#: Bands times rows minima; a pair at 0.8 is missed by all bands once in two million times.
BANDS, ROWS, B = 28, 4, 4
#: Minima of the sketch; the bands take the first of them.
N = 320
#: Estimates may fall short by so much (five deviations of 320 places) before a pair is dropped without a look at its sets.
SLACK = 0.12
#: Members of a bucket that are put in order together, and rounds of that.
PART, ROUNDS = 2048, 2
#: Bytes of sets in a cell of pairs.
CELL_BYTES = 16_000_000
PACKED = N * B // 64
SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"
_WORDS = WordIds()
_RNG = np.random.default_rng(2024)
_A = (_RNG.integers(1, 1 << 32, N, dtype=np.uint64) | U64(1)).astype(np.uint32)
_C = _RNG.integers(0, 1 << 32, N, dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text; of all its words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    return np.unique(mix(rolling(sole(_WORDS).of(words), min(k, len(words)))))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> U64(32)).astype(np.uint32)
    least = np.full(N, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (_A[:, None] * x[None, i : i + 4096] + _C[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    low = ((least ^ (least >> np.uint32(15))) & np.uint32((1 << B) - 1)).astype(U64).reshape(PACKED, 64 // B)
    return (low << (np.arange(64 // B, dtype=U64) * U64(B))).sum(axis=1, dtype=U64).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """SIGNATURE of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, sets, bands, bits = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                x = shingles(text or b"", k)
                least = minima(x) if len(x) else None
                n.append(len(x))
                sets.append(xxhash.xxh3_128_digest(x.tobytes()))
                bands.append([] if least is None else band_keys(least))
                bits.append([] if least is None else packed(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)], names=[c.split()[0] for c in SIGNATURE.split(", ")])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of each row, shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            x = [np.sort(shingles(t or b"", k).view(np.int64)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed columns: the share of equal places, less what chance makes equal."""
    ones = "".join(["0" * (B - 1) + "1"] * (64 // B))
    ones = int(ones, 2)
    ones = ones - (1 << 64) if ones >> 63 else ones
    differ = "+".join(
        f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {ones}L)"
        for x in (f"({a}[{i}] ^ {b}[{i}])" for i in range(PACKED))
    )
    chance = 1 / (1 << B)
    return F.expr(f"((({N} - ({differ})) / {float(N)}D) - {chance}D) / {1 - chance}D")


def _possible(least: int) -> Column:
    """Sizes allow it, and the estimate does not rule it out."""
    return F.expr(f"100 * least(n, n2) >= {least} * greatest(n, n2)") & (estimate("bits", "bits2") >= least / 100 - SLACK)


def alike(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two ordered sets overlap by `least` hundredths or more."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= least * (len(x) + len(y) - common)


def _confirmer(least: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for doc, x in zip(sets.column("doc_id").to_pylist(), sets.column("shingles"), strict=True):
            held.setdefault(doc, np.asarray(x.values.to_numpy()))
        ends = zip(map(held.get, pairs.column("a").to_pylist()), map(held.get, pairs.column("b").to_pylist()), strict=True)
        kept = [i for i, (x, y) in enumerate(ends) if x is not None and y is not None and alike(x, y, least)]
        release()
        return pairs.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


_ONES = U64(int("".join(["0" * (B - 1) + "1"] * (64 // B)), 2))
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _likely(bits: np.ndarray, others: np.ndarray, n: np.ndarray, ns: np.ndarray, least: int) -> np.ndarray:
    """Which of the others each sketch could reach `least` hundredths with (rows x others)."""
    differ = np.zeros((len(bits), len(others)), np.uint16)
    for w in range(bits.shape[1]):
        x = bits[:, w, None] ^ others[None, :, w]
        x |= x >> U64(1)
        x |= x >> U64(2)
        differ += np.bitwise_count(x & _ONES)
    chance = 1 / (1 << B)
    most = N * (1 - (chance + (1 - chance) * (least / 100 - SLACK)))
    small, large = np.minimum(n[:, None], ns[None, :]), np.maximum(n[:, None], ns[None, :])
    return (differ <= most) & (100 * small >= least * large)


def _block(least: int):
    def run(left: pa.Table) -> pa.Table:
        """The documents of a block, those of side 0 against those of side 1 (or one side against itself)."""
        doc, root, n, side = (left.column(c).to_numpy() for c in ("doc_id", "root", "n", "side"))
        bits = np.stack([x.values.to_numpy() for x in left.column("bits")]).view(U64)
        sets = [x.values.to_numpy() for x in left.column("shingles")]
        up = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        rows, others = (np.flatnonzero(side == s) for s in (0, 1)) if side.any() else (np.arange(len(doc)),) * 2
        out = []
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            hits = _likely(bits[part], bits[others], n[part], n[others], least) & (root[part][:, None] != root[others][None, :])
            if rows is others:
                hits &= part[:, None] < others[None, :]
            for p, q in zip(*(x.tolist() for x in np.nonzero(hits)), strict=True):
                x, y = int(part[p]), int(others[q])
                a, b = top(int(root[x])), top(int(root[y]))
                if a != b and alike(sets[x], sets[y], least):
                    up[max(a, b)] = min(a, b)
                    out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
        release()
        return pa.Table.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], schema=_LINK)

    return run


def across(apart: DataFrame, docs: DataFrame, k: int, least: int) -> DataFrame:
    """Links (a, b) between different components that connect members of one bucket, as _apart has them.

    Buckets of the same least member share a block, so a document stands once where many buckets repeat it. The members of
    a block of over PART documents are dealt to parts, and each pair of parts is a block of its own.
    """
    hubs = apart.groupBy("key").agg(F.min("doc_id").alias("hub"))
    held = apart.join(hubs, "key").groupBy("hub", "doc_id").agg(F.first("root").alias("root"))
    parts = held.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {PART}) as int)").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub", "parts")
    dealt = held.join(parts, "hub").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
    dealt = dealt.select("hub", "doc_id", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("beside"))
    dealt = dealt.selectExpr("hub", "doc_id", "root", "least(part, beside) as low", "greatest(part, beside) as high", "cast(part > beside as int) as side")
    ids = dealt.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = materialise(sets_of(texts, k), "sets").dropDuplicates(["doc_id"])
    sketches = apart.select("doc_id", "n", "bits").dropDuplicates(["doc_id"])
    return dealt.join(sketches, "doc_id").join(sets, "doc_id").groupBy("hub", "low", "high").applyInArrow(_block(least), "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs (a, b) of (a, b, n) whose full sets overlap by `least` hundredths or more; n is the size of both sets.

    Pairs are dealt to a grid by both ends, so that no document gathers all its pairs in one task, and each set is sent
    to a cell once, however many of the cell's pairs need it. A cell's sets stay below about CELL_BYTES.
    """
    size = (pairs.agg(F.sum("n")).first()[0] or 0) * 8
    side = max(1, int(np.ceil((size / CELL_BYTES) ** 0.5)))
    dealt = pairs.select("a", "b", F.expr(f"cast(pmod(xxhash64(a), {side}) * {side} + pmod(xxhash64(b), {side}) as int)").alias("cell"))
    ends = dealt.selectExpr("cell", "a as doc_id").union(dealt.selectExpr("cell", "b")).distinct()
    texts = docs.select("doc_id", "text").join(ends.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = materialise(sets_of(texts, k), "sets")
    sent = sets.join(ends, "doc_id").select(F.col("cell").alias("at"), "doc_id", "shingles")
    confirmed = materialise(dealt.groupBy("cell").cogroup(sent.groupBy("at")).applyInArrow(_confirmer(least), "a long, b long"), "pairs")
    discard(sets)
    return confirmed


def _apart(rows: DataFrame, sketches: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, doc_id, size, root, n, bits) of the buckets whose members are not all connected."""
    if roots is None:
        rows = rows.withColumn("root", F.col("doc_id"))
    else:
        rows = rows.join(roots, rows.doc_id == roots.node, "left").select("key", "doc_id", "size", F.coalesce("root", "doc_id").alias("root"))
        split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        rows = rows.join(split, "key")
    return rows.join(sketches, "doc_id")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, n, root, root2, alike): each pair once, a < b."""
    smaller = F.col("doc_id") < F.col("b")
    return pairs.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"), (F.col("n") + F.col("n2")).alias("n"), F.when(smaller, F.col("root")).otherwise(F.col("root2")).alias("root"), F.when(smaller, F.col("root2")).otherwise(F.col("root")).alias("root2"), estimate("bits", "bits2").alias("alike")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """For each component, its pair of the highest estimate; ties go to the smaller ids."""
    pick = F.max(F.struct("alike", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "n")).alias("pick")
    ends = pairs.union(pairs.select("a", "b", "n", "root2", "root", "alike"))
    return ends.groupBy("root").agg(pick).selectExpr("-pick.a as a", "-pick.b as b", "pick.n as n").distinct()


def links(docs: DataFrame, known: DataFrame, k: int, least: int) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all that can be connected."""
    some = known.where("n_shingles > 0")
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    members = some.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = members.select("doc_id", F.explode("bands").alias("key"))
    rows = materialise(rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "buckets")
    shared = rows.select("doc_id").distinct()
    sketches = materialise(members.select("doc_id", F.col("n_shingles").alias("n"), "bits").join(shared, "doc_id"), "sketches")
    found, roots = None, None
    for i in range(ROUNDS):
        part = F.expr(f"pmod(xxhash64(doc_id, {i}), ceil(size / {PART}))")
        order = Window.partitionBy("key", part).orderBy(F.col("bits")[3 * i], F.col("bits")[3 * i + 1], F.xxhash64("doc_id", F.lit(i)))
        after = F.lead(F.struct(F.col("doc_id").alias("b"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))).over(order)
        beside = _apart(rows, sketches, roots).withColumn("after", after).select("doc_id", "root", "n", "bits", "after.*")
        picked = materialise(_best(_ordered(beside.where("root <> root2").where(_possible(least)))), "candidates")
        confirmed = confirm(picked, docs, k, least)
        before, found = found, materialise(confirmed if found is None else found.union(confirmed).distinct(), "confirmed")
        roots = components(found)
        if before is not None and before.count() == found.count():
            break
    apart = materialise(_apart(rows, sketches, roots), "apart")
    discard(rows, sketches)
    return found.union(across(apart, docs, k, least)).distinct()


def _find(docs: DataFrame, known: DataFrame, k: int, least: int) -> DataFrame:
    roots = components(links(docs, known, k, least))
    same = known.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    same = same.join(roots, "node", "left").select("set_hash", F.coalesce("root", "node").alias("root"))
    joined = known.select("doc_id", "text_hash", "n_shingles", "set_hash").join(same, "set_hash", "left")
    return joined.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def find(docs: DataFrame, k: int = 5, least: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row; `least` is the similarity in hundredths."""
    known = materialise(signatures(docs, k), "signatures")
    several = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a <> b")
    if several.isEmpty():
        found = _find(docs, known, k, least)
    else:
        # An id that stands with several texts cannot name them: rows are numbered, and components named by ids again.
        rows = materialise(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
        numbered = rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
        each = _find(numbered, materialise(signatures(numbered, k), "signatures"), k, least).withColumnRenamed("doc_id", "row")
        each = each.join(rows.select("row", "doc_id"), "row")
        least_id = each.groupBy("component_id").agg(F.min("doc_id").alias("least_id"))
        found = each.join(least_id, "component_id").select("doc_id", "text_hash", "n_shingles", F.col("least_id").alias("component_id"))
        found = found.unionByName(known.where("doc_id is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def unique(docs: DataFrame, k: int = 5, least: int = 80) -> DataFrame:
    """One row of each group: that of the smallest id, once. Rows without an id all stay. Columns are those of `docs`."""
    found = materialise(find(docs, k, least), "near").where("doc_id is not null")
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone.union(repeated).distinct(), "doc_id", "left_anti")
    stays = found.where("kept").select("doc_id", "text_hash").distinct().join(repeated, "doc_id", "left_semi")
    # Only the rows of repeated ids are moved with their texts; of rows with the same id and text the first in order stays.
    again = docs.join(repeated, "doc_id", "left_semi").withColumn("text_hash__", F.xxhash64("text"))
    again = again.join(stays.withColumnRenamed("text_hash", "text_hash__"), ["doc_id", "text_hash__"], "left_semi").dropDuplicates(["doc_id", "text_hash__"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
