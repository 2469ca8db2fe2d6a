"""TIFF media columns: write images, walk image directories, decode pages.

Reads baseline and common extended files of either byte order: any number of image file
directories, strips or tiles, chunky or planar samples of 8 or 16 bits, compression none (1),
LZW (5), deflate (8 and 32946) or PackBits (32773), and predictor 1 or 2. One row per page.

Defined results: null or empty media have no pages; bytes that are no TIFF, a directory chain that
loops, strips or tiles that are cut short and unsupported features give one row with ``error`` set, after
the pages before it, instead of failing the job; a page may have as many bytes as a row of Spark can (``PAGE_BYTES``), and
what it claims is checked against the bytes that are there before memory is taken; an empty or very long text is stored like any other,
a page for each 256 KB; repeated rows are read each for itself; an empty table gives no rows; a column named like a result is replaced.
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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raywalk.llm import shared

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Bytes of each field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 4096, 1024, 32
#: Most bytes of a page's pixels: a binary cell of a row holds no more.
PAGE_BYTES = (1 << 31) - 1024
#: Most bytes that a stored byte can stand for: deflate's is the largest of all codecs but LZW, whose codes of 12 bits stand for up to 4096 each.
_GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
#: Bytes of pixels that a batch of pages holds before it is passed on.
BATCH_BYTES = 8 << 20


class TiffError(ValueError):
    """The bytes are no TIFF that this reader supports."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples

    def bytes(self) -> bytes:
        return self.pixels.tobytes()


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes are stored as a count and the byte, the rest as counted literals."""
    a = np.frombuffer(data, np.uint8)
    out, at = bytearray(), 0

    def literals(upto: int) -> None:
        for i in range(at, upto, 128):
            j = min(i + 128, upto)
            out.append(j - i - 1)
            out.extend(data[i:j])

    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edges) > 2)
    for s, e in zip(edges[long].tolist(), edges[long + 1].tolist()):
        literals(s)
        while e - s > 1:
            k = min(e - s, 128)
            out += bytes((257 - k, data[s]))
            s += k
        at = s  # one byte of the run may be left, as a literal
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def _code_widths(first: int, n: int) -> np.ndarray:
    """Bits of codes number ``first`` to ``first + n`` after a clear code: one entry joins the table of 258 with each."""
    free = 258 + first + np.arange(n)
    return 9 + (free >= 512) + (free >= 1024) + (free >= 2048)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a clear code first and whenever the table fills."""
    parts: list[list[int]] = []  # codes from one clear code to the next, which ends the part
    codes: list[int] = []
    table: dict[int, int] = {}
    free, have = 258, -1
    for c in data:
        if have < 0:
            have = c
            continue
        key = have << 8 | c
        got = table.get(key)
        if got is not None:
            have = got
            continue
        codes.append(have)
        table[key] = free
        free += 1
        if free == 4095:
            codes.append(256)
            parts.append(codes)
            codes, table, free = [], {}, 258
        have = c
    if have >= 0:
        codes.append(have)
    parts.append([*codes, 257])
    code = np.array([256, *(c for p in parts for c in p)])
    width = np.concatenate([[9], *(_code_widths(0, len(p)) for p in parts)])
    place = np.arange(12)
    bits = code[:, None] >> np.maximum(width[:, None] - 1 - place, 0) & 1
    return np.packbits(bits[place < width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, out, got, at = 8 * len(data), [], 0, 0
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, seen, last = list(first), 0, b""
    while got < size:
        # codes up to the next clear code: their widths follow from their number
        width = _code_widths(seen, min(4096, 16 + 2 * (size - got)))
        ends = at + np.cumsum(width)
        width, ends = width[ends <= total], ends[ends <= total]
        if not len(ends):
            break
        start = ends - width
        low = start >> 3
        code = ((raw[low] << 16 | raw[low + 1] << 8 | raw[low + 2]) >> (24 - (start & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((code == 256) | (code == 257))
        n = int(stop[0]) if len(stop) else len(code)
        for c in code[:n].tolist():
            if c < len(table):
                entry = table[c]
            elif c == len(table) and last:
                entry = last + last[:1]
            else:
                raise TiffError("bad LZW code")
            out.append(entry)
            got += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            if got >= size:
                break
        if n < len(code) and code[n] == 257:
            break
        if n < len(code):
            table, seen, last, at = list(first), 0, b"", int(ends[n])
        else:
            seen, at = seen + n, int(ends[-1])
    return b"".join(out)[:size]


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        change = block.copy()
        change[:, 1:] -= block[:, :-1]
        block = change
    data = block.tobytes()
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:  # a row is packed for itself
        w = block.shape[1]
        runs = ((block[:, 2:] == block[:, 1:-1]) & (block[:, 1:-1] == block[:, :-2])).any(axis=1).tolist() if w > 2 else [False] * len(block)
        rows = (data[i * w : i * w + w] for i in range(len(block)))
        plain, made = bytes((min(w, 128) - 1,)), {}
        out = []
        for row, run in zip(rows, runs):
            if not run and w <= 128:
                out += (plain, row)
            else:
                if row not in made:
                    made[row] = packbits_encode(row)
                out.append(made[row])
        return b"".join(out)
    return data


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian file of 8-bit grey pages, in strips, or in square tiles if ``tile`` is set."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        h, w = page.shape
        parts = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    cut = page[y : y + tile, x : x + tile]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(_packed(block, compression, predictor))
        else:
            parts = [_packed(page[y : y + strip_rows], compression, predictor) for y in range(0, h, strip_rows)]
        where = []
        for p in parts:
            where.append(len(out))
            out += p
            out += b"\0" * (len(out) % 2)
        sizes = [len(p) for p in parts]
        fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, where), (325, 4, sizes)] if tile else [(273, 4, where), (278, 4, [strip_rows]), (279, 4, sizes)]
        if predictor != 1:
            fields.append((317, 3, [predictor]))
        body = bytearray()
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out) + len(body)))
                body += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI4s", tag, kind, len(values), raw.ljust(4, b"\0")))
        out += body
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, e: str) -> tuple[dict[int, list], int]:
    try:
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for i in range(n):
            where = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(e + "HHI", data, where)
            size = _SIZES.get(kind, 1) * count
            if size > len(data):
                raise TiffError("a field is longer than the file")
            start = where + 8 if size <= 4 else struct.unpack_from(e + "I", data, where + 8)[0]
            code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
            if code:
                tags[tag] = list(struct.unpack_from(f"{e}{count}{code}", data, start))
        return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]
    except struct.error:
        raise TiffError("truncated directory") from None


def _decoded(raw: bytes, compression: int, size: int) -> bytes:
    if compression not in NAMES:
        raise TiffError(f"compression {compression} isn't supported")
    if compression == NONE:
        return raw[:size]
    if size > _GROWTH.get(compression, 0) * (len(raw) + 8):
        raise TiffError("a strip or tile is too short")
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(raw, size) if size else b""
        except zlib.error as x:
            raise TiffError(f"bad deflate data: {x}") from None
    if compression == LZW:
        return lzw_decode(raw, size)
    return packbits_decode(raw, size)


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the chain of image directories and decode each page."""
    e = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if e is None or len(data) < 8:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, e)
        yield _page(data, tags, len(seen) - 1, e)
        at = following


def _page(data: bytes, tags: dict[int, list], index: int, e: str) -> Page:
    if 256 not in tags or 257 not in tags:
        raise TiffError("no width or height")
    for tag in (256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325):
        if any(not isinstance(v, int) or v < 0 for v in tags.get(tag, ())):
            raise TiffError(f"field {tag} isn't a whole number")
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    w, h, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    if bits not in (8, 16) or len(set(tags.get(258, [bits]))) > 1 or predictor not in (1, 2):
        raise TiffError(f"{bits} bits with predictor {predictor} aren't supported")
    if not w or not h or not samples or planar not in (1, 2):
        raise TiffError("a page without pixels")
    if w * h * samples * bits // 8 > PAGE_BYTES:
        raise TiffError("the page is larger than 2 GB")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(e)
    tiled = 324 in tags
    bh, bw = (one(323, 0), one(322, 0)) if tiled else (min(one(278, h), h), w)
    where, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if not bh or not bw or (tiled and (bh > 2 * h + 4096 or bw > 2 * w + 4096)):
        raise TiffError("strips or tiles of no sensible size")
    rows, across = -(-h // bh), -(-w // bw)
    if not where or not sizes or len(where) != len(sizes) or len(where) < rows * across * planes:
        raise TiffError("strips or tiles are missing")
    if w * h * samples * kind.itemsize > _GROWTH.get(compression, 0) * (sum(sizes) + 8 * len(sizes)) or sum(sizes) > len(data):
        raise TiffError("strips or tiles that the file can't hold")
    out = np.zeros((h, w, samples), kind)
    for k in range(rows * across * planes):
        plane, rest = divmod(k, rows * across)
        y, x = rest // across * bh, rest % across * bw
        high = bh if tiled else min(bh, h - y)
        size = high * bw * deep * kind.itemsize
        raw = _decoded(data[where[k] : where[k] + sizes[k]], compression, size)
        if len(raw) < size:
            raise TiffError(f"a strip or tile has {len(raw)} of {size} bytes")
        block = np.frombuffer(raw, kind).reshape(high, bw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        cut = block[: h - y, : w - x]
        if planes == 1:
            out[y : y + cut.shape[0], x : x + cut.shape[1]] = cut
        else:
            out[y : y + cut.shape[0], x : x + cut.shape[1], plane] = cut[:, :, 0]
    return Page(index, w, h, samples, bits, compression, predictor, tiled, out)


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64 of them, as grey rows of 64 samples, a page for each 256 KB. A checksum of the bytes picks
    codec (PackBits, LZW, deflate or none), predictor (for LZW and deflate) and strips or tiles, so texts of all
    lengths meet all of them and equal texts are stored alike."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pages = [image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)]
    mark = zlib.crc32(payload)
    codec = (PACKBITS, LZW, DEFLATE, NONE, DEFLATE, PACKBITS, DEFLATE, NONE)[mark & 7]
    predictor = 1 + (mark >> 3 & 1) if codec in (LZW, DEFLATE) else 1
    return write_tiff(pages, codec, predictor, TILE if mark >> 4 & 1 else 0)


class Features:
    """Page count, size, compression, mean, mean square and the largest of 16 brightness bins, page by page."""

    def __init__(self):
        self.hist, self.pages, self.rows, self.width, self.name = np.zeros(256, np.int64), 0, 0, 0, ""

    def add(self, pixels: np.ndarray, bits: int, width: int, height: int, name: str) -> None:
        self.hist += np.bincount((pixels >> (bits - 8)).astype(np.uint8), minlength=256)
        if not self.pages:
            self.width, self.name = width, name
        self.pages, self.rows = self.pages + 1, self.rows + height

    def text(self) -> str:
        if not self.pages:
            return "pages=0"
        total, level = int(self.hist.sum()), np.arange(256)
        mean = int((self.hist * level).sum()) * 1000 // max(total, 1)
        square = int((self.hist * level * level).sum()) * 1000 // max(total, 1)
        top = int(self.hist.reshape(16, 16).sum(axis=1).argmax())
        return f"pages={self.pages};size={self.width}x{self.rows};{self.name};mean={mean};square={square};bin={top}"


def encode_texts(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add the TIFF bytes of each whole text, padded with bytes 0 to a positive multiple of 64, and its unpadded size."""
    names = [c for c in df.columns if c not in (out, "n_bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for t in batch.column(text):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                sizes.append(len(raw))
                media.append(store(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", out])

    shared.bounded_batches(df.sparkSession)
    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in names]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())]))


def _read_all(data: bytes) -> Iterator[tuple]:
    k = 0
    try:
        for p in read_pages(data):
            yield (p.index, p.width, p.height, p.samples, p.bits, NAMES[p.compression], p.tiled, p.bytes(), None)
            k += 1
    except (TiffError, struct.error, ValueError, TypeError, IndexError, OverflowError, MemoryError, zlib.error) as x:
        yield (k, None, None, None, None, None, None, None, str(x) or type(x).__name__)


def pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: ``page``, ``width``, ``height``, ``samples``, ``bits``, ``compression``, ``tiled``, ``pixels``, ``error``. The pages
    of a row follow one another in one partition."""
    shared.bounded_batches(df.sparkSession)
    fields = ["page", "width", "height", "samples", "bits", "compression", "tiled", "pixels", "error"]
    names = [c for c in df.columns if c not in fields and c != media]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, of, held, size = batch.select(names), [], [], 0

            def out() -> pa.RecordBatch:
                same = rest.take(pa.array(of, pa.int64()))
                made = [pa.array(column, kind) for column, kind in zip(zip(*held), kinds)]
                return pa.RecordBatch.from_arrays([*same.columns, *made], [*names, *fields])

            for i, data in enumerate(batch.column(media)):
                for found in _read_all(data.as_py()) if data.is_valid and len(data.as_buffer()) else ():
                    of.append(i)
                    held.append(found)
                    size += len(found[7] or b"")
                    if size > BATCH_BYTES:
                        yield out()
                        of, held, size = [], [], 0
            if held:
                yield out()

    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in names]
    sql = [T.IntegerType(), T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.BinaryType(), T.StringType()]
    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(fields, sql))]))


def payload_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """Read the stored bytes back, page by page, and add size and digests of the pixels, of their last 64 bytes and of the file, and ``feature``. A
    row without media has no pages and isn't returned; one that can't be read raises."""
    made = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    names = [c for c in df.columns if c != media and c not in made]
    stored = df.select(*(F.col(f"`{c}`") for c in names), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), F.col(media))
    passed = [*names, "media_bytes", "media_sha256"]
    read = pages(stored.select(F.struct(*(F.col(f"`{c}`") for c in passed)).alias("whole"), F.col(media)), media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, size, digest, tail, feature = None, 0, None, b"", None
        for batch in batches:
            done = []
            for k, (page, width, height, bits, name, error) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "width", "height", "bits", "compression", "error")))):
                if error is not None:
                    raise TiffError(error)
                pixels = batch.column("pixels")[k].as_buffer()
                if page == 0:
                    if whole is not None:
                        done.append((whole, size, digest.hexdigest(), zlib.crc32(tail), feature.text()))
                    whole, size, digest, tail, feature = batch.column("whole").slice(k, 1), 0, hashlib.sha256(), b"", Features()
                digest.update(pixels)
                size += len(pixels)
                tail = (tail + bytes(pixels[-64:]))[-64:]
                feature.add(np.frombuffer(pixels, np.uint8 if bits == 8 else np.uint16), bits, width, height, name)
            if done:
                yield _digested(done)
        if whole is not None:
            yield _digested([(whole, size, digest.hexdigest(), zlib.crc32(tail), feature.text())])

    kept = [T.StructField("whole", read.schema["whole"].dataType)]
    more = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType())]
    out = read.select("whole", "page", "width", "height", "bits", "compression", "pixels", "error").mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in more)]))
    return out.select(*(F.col("whole").getField(c).alias(c) for c in names), *(F.col("whole").getField(c).alias(c) if c.startswith("media") else F.col(c) for c in made))


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    wholes, *columns = zip(*rows)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.concat_arrays(wholes), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["whole", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
