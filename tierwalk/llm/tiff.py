"""TIFF as a media column: write samples as pages, walk image directories, decode strips and tiles, one row per page.

Reads both byte orders, uncompressed, PackBits, LZW and deflate data, strips and tiles, samples of 1 to 64 bits, chunky or
in planes, and undoes horizontal differencing and the floating point predictor. Writes 8 bit samples (uncompressed, PackBits
and deflate; LZW is read only).

What a header says is held against the file before anything is allocated: a page of more bytes than its stored parts could
unpack to, or than `PAGE_BYTES`, is a fault, and a part is never unpacked beyond its size.

Edge cases: a file with a fault of any kind gives the pages before the fault and then one row with `error` set and no
samples; a directory chain that loops ends at the first repeat; null bytes count as an unreadable file; an empty table gives
an empty table; in `op2`, a null or empty text is a payload of one row of 255s.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierwalk.llm.common import rows_of

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
ROW = 576
PAGE_ROWS, STRIP_ROWS = 512, 128
#: Bytes of one value of each field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "samples": 277, "planar": 284, "predictor": 317, "format": 339}
DEFAULTS = {"bits": 1, "compression": NONE, "samples": 1, "planar": 1, "predictor": 1, "format": 1}
#: Bytes that one stored byte can unpack to at most: a repeat of 128 in two bytes, strings of under 4096 in codes of 9 bits,
#: runs of 258 in two bits.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 3641, DEFLATE: 1032, 32946: 1032}
PAGE_BYTES = 1 << 30
#: Kinds of samples by format and bits.
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8", (3, 16): "f2", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Page:
    pixels: np.ndarray  # height x width x samples
    compression: int
    predictor: int
    tiled: bool


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    """One row: runs of three equal bytes and more as repeats, the rest as literals."""
    a = np.frombuffer(row, np.uint8)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1, [len(a)]))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for j in range(0, len(literal), 128):
            part = literal[j : j + 128]
            out.extend(bytes([len(part) - 1]) + part)
        literal.clear()

    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e - s < 3:
            literal += row[s:e]
            continue
        flush()
        for j in range(s, e, 128):
            n = min(128, e - j)
            out += bytes([257 - n, row[s]]) if n > 1 else bytes([0, row[s]])
    flush()
    return bytes(out)


def unlzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, last = list(start), 9, [], None
    held = bits = at = n = 0
    while n < most:
        while bits < width and at < len(data):
            held = held << 8 | data[at]
            bits, at = bits + 8, at + 1
        if bits < width:
            break
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if last is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise ValueError("LZW code beyond the table")
        out.append(entry)
        n += len(entry)
        last = entry
        width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return b"".join(out)


def _plain(data: bytes, compression: int, size: int) -> bytes:
    """The first `size` bytes that a stored part unpacks to."""
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    return unpack_bits(data, size) if compression == PACKBITS else data


def _samples(raw: bytes, rows: int, width: int, per: int, kind: np.dtype | None, bits: int, predictor: int) -> np.ndarray:
    """rows x width x per samples of an unpacked part, in this machine's order."""
    if kind is None:  # less than a byte each, rows start at whole bytes
        line = -(-width * per * bits // 8)
        each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : width * per * bits]
        return np.packbits(each.reshape(rows, width, per, bits), axis=3)[..., 0] >> (8 - bits)
    if predictor == 3:
        # Each row holds the bytes of all samples by significance, highest first, as differences to the byte `per` before.
        line = np.frombuffer(raw, np.uint8, rows * width * per * kind.itemsize).reshape(rows, -1, per)
        planes = np.cumsum(line, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * per)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, per).astype(kind.newbyteorder("="))
    part = np.frombuffer(raw, kind, rows * width * per).reshape(rows, width, per)
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
    return part.astype(kind.newbyteorder("="), copy=False)


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """Fields by tag of each image directory in turn."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields: dict[int, list] = {0: [order]}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count, where = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            if kind in (1, 3, 4):
                place = at + 10 + 12 * i if SIZES[kind] * count <= 4 else where
                fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read(data: bytes, most: int = PAGE_BYTES) -> Iterator[Page]:
    """Pages in turn; a fault raises after the pages before it."""
    for f in directories(data):
        g = {k: f.get(t, [DEFAULTS.get(k)])[0] for k, t in TAGS.items()}
        width, height, samples, bits, predictor, compression = (g[k] for k in ("width", "height", "samples", "bits", "predictor", "compression"))
        code = KINDS.get((g["format"], bits))
        kind = np.dtype(f[0][0] + code) if code else None
        if any(b != bits for b in f.get(TAGS["bits"], ())) or kind is None and not (bits in (1, 2, 4) and g["format"] == 1):
            raise ValueError(f"samples of {f.get(TAGS['bits'])} bits, format {g['format']}, are not read")
        if compression not in GROWTH or g["planar"] not in (1, 2) or predictor not in (1, 2, 3):
            raise ValueError(f"compression {compression}, planar {g['planar']}, predictor {predictor} are not read")
        if predictor > 1 and (kind is None or (predictor == 3) != (kind.kind == "f")):
            raise ValueError(f"predictor {predictor} does not go with samples of {bits} bits, format {g['format']}")
        tiled = 324 in f
        w, h = (f[322][0], f[323][0]) if tiled else (width, min(f.get(278, [height])[0], height))
        if not all(isinstance(n, int) and n > 0 for n in (width, height, samples, w, h)):
            raise ValueError(f"a page of {width} x {height} x {samples} in parts of {w} x {h}")
        offsets, counts = (f[324], f[325]) if tiled else (f[273], f.get(279) or [len(data)])
        planes, per = (samples, 1) if g["planar"] == 2 else (1, samples)
        across, down = -(-width // w), -(-height // h)
        if not len(offsets) == len(counts) == across * down * planes:
            raise ValueError(f"{len(offsets)} offsets and {len(counts)} counts of {across * down * planes} parts")
        size = bits if kind is None else 8 * kind.itemsize
        line = -(-w * per * size // 8)
        page = width * height * samples * (1 if kind is None else kind.itemsize)
        if page > most or line * h > most:
            raise ValueError(f"a page of {page} bytes in parts of {line * h}; {most} are allowed")
        stored = [data[o : o + c] for o, c in zip(offsets, counts, strict=True)]
        if sum(map(len, stored)) * GROWTH[compression] * 8 < width * height * samples * size:
            raise ValueError(f"{sum(map(len, stored))} stored bytes cannot hold {page}")
        pixels = np.zeros((height, width, samples), np.uint8 if kind is None else kind.newbyteorder("="))
        for i, part in enumerate(stored):
            plane, at = divmod(i, across * down)
            y, x = at // across * h, at % across * w
            rows = h if tiled else min(h, height - y)
            got = _samples(_plain(part, compression, line * rows), rows, w, per, kind, bits, predictor)
            ny, nx = min(rows, height - y), min(w, width - x)
            into = pixels[y : y + ny, x : x + nx]
            into[:, :, slice(plane, plane + 1) if planes > 1 else slice(None)] = got[:ny, :nx]
        yield Page(pixels, compression, predictor, tiled)


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = STRIP_ROWS, tile: int = 0, order: str = "<") -> bytes:
    """A file of 8 bit grey pages (height x width): strips of `rows`, or tiles of `tile` squared."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            full[:height, :width] = page
            parts = [full[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [page[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            raw = part.tobytes()
            data = zlib.compress(raw, 1) if compression == DEFLATE else b"".join(pack_bits(r.tobytes()) for r in part) if compression == PACKBITS else raw
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                packed, where = struct.pack(order + "I", len(out)), packed
                out += where
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(text: bytes) -> bytes:
    """A text as pages of 576 samples a row: bytes 255 fill the last row; at least one row."""
    rows = max(1, -(-len(text) // ROW))
    samples = np.full(rows * ROW, 255, np.uint8)
    samples[: len(text)] = np.frombuffer(text, np.uint8)
    return write([samples.reshape(rows, ROW)[i : i + PAGE_ROWS] for i in range(0, rows, PAGE_ROWS)], DEFLATE, predictor=2)


def payload(media: bytes) -> bytes:
    return b"".join(page.pixels.tobytes() for page in read(media))


def feature(pages: list[Page]) -> str:
    """Size, mean, deviation and quarters of the samples: whole-number sums, so equal samples give equal text."""
    n = total = squares = 0
    quarters = np.zeros(4, np.int64)
    for page in pages:
        counts = np.bincount(page.pixels.ravel(), minlength=256)
        values = np.arange(256)
        n, total, squares = n + page.pixels.size, total + int(counts @ values), squares + int(counts @ values**2)
        quarters += counts.reshape(4, 64).sum(axis=1)
    mean = total / n
    return f"pages={len(pages)};samples={n};mean={mean:.4f};deviation={max(0.0, squares / n - mean * mean) ** 0.5:.4f};quarters=" + "/".join(map(str, quarters))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            data = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in data], pa.int64()), "media": pa.array(map(store, data), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = "id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, sha256 string, mean double, error string"


def page_rows(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per page of each file, PAGES; an unreadable file gives its pages before the fault, then a row with `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 64):
            rows = []
            for key_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = 0
                try:
                    for i, p in enumerate(read(data or b""), 1):  # noqa: B007
                        h, w, s = p.pixels.shape
                        rows.append((key_, i - 1, w, h, s, p.compression, p.predictor, p.tiled, hashlib.sha256(p.pixels.tobytes()).hexdigest(), float(p.pixels.mean()), None))
                except Exception as e:  # noqa: BLE001 - whatever a forged file leads to is a fault of that file alone
                    rows.append((key_, i, *[None] * 8, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.string(), pa.float64(), pa.string()]
            names = [c.split()[0] for c in PAGES.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return files.select(key, media).mapInArrow(run, PAGES)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(files: DataFrame) -> DataFrame:
    """The contract's row of each stored text, all from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in rows_of(batches, 256):
            rows = []
            for doc, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pages = list(read(media))
                data = b"".join(p.pixels.tobytes() for p in pages)
                rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages)))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, DIGEST)
