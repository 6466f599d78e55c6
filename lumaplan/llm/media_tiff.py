"""TIFF media columns: image directories, strips and tiles, PackBits, LZW and deflate, predictors; one row per page."""

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
from pyspark.sql.types import StructType

from lumaplan.llm.common import text_buffer

# Fixed values of the TIFF 6.0 format: field types and their sizes, tags, compression schemes.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FILL_ORDER, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


#: The most bytes of pixels that one byte of file may stand for: over deflate's 1032, which is the most of any scheme here but LZW.
DENSEST = 4096
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class TiffError(ValueError):
    """The bytes are no TIFF that this reader can read."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    sample_format: int
    pixels: bytes


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while len(out) < size and i < n:
        h = data[i]
        if h < 128:
            out += data[i + 1 : i + 2 + h]
            i += h + 2
        else:
            if h > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - h)
            i += 2 if h > 128 else 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
        else:
            j = i + 1
            while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Most significant bit first; 256 clears, 257 ends; codes widen one entry early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, width, acc, have, prev = list(base), bytearray(), 9, 0, 0, None
    for byte in data:
        acc, have = (acc << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if prev is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = prev + prev[:1]
            else:
                raise TiffError("LZW code out of range")
            table.append(prev + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += entry
        prev = entry
        if len(out) >= size:
            break
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, acc, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = acc << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(acc >> have & 255)
        acc &= (1 << have) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            run = longer
            continue
        put(run[0] if len(run) == 1 else table[run])
        table[longer] = size
        size += 1
        if size == 4095:
            put(256)
            table, width, size = {}, 9, 258
        elif size >= 1 << width:
            width += 1
        run = data[i : i + 1]
    if run:
        put(run[0] if len(run) == 1 else table[run])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(acc << (8 - have) & 255)
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


DECODERS = {NONE: lambda d, n: d[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


def iter_tiff(data: bytes | None, max_pages: int | None = None, max_page_bytes: int = 1 << 28) -> Iterator[Page]:
    """The pages in order of the chain of image directories, one at a time. Raises TiffError at the first fault, whatever the bytes
    are; pages before it have been given."""
    try:
        yield from _pages(data, max_pages, max_page_bytes)
    except TiffError:
        raise
    except (struct.error, LookupError, ArithmeticError, TypeError, ValueError, MemoryError) as err:
        raise TiffError(f"truncated or damaged: {err}") from err


def read_tiff(data: bytes | None, max_pages: int | None = None) -> list[Page]:
    """All pages. Raises TiffError."""
    return list(iter_tiff(data, max_pages))


def _pages(data: bytes | None, max_pages: int | None, max_page_bytes: int) -> Iterator[Page]:
    if not data or len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    (version,) = struct.unpack_from(f"{e}H", data, 2)
    big = version == 43
    if version not in (42, 43):
        raise TiffError(f"version {version}")
    (at,) = struct.unpack_from(f"{e}Q", data, 8) if big else struct.unpack_from(f"{e}I", data, 4)
    seen: set[int] = set()
    while at and len(seen) != max_pages:
        if at in seen:
            raise TiffError("the chain of directories is a loop")
        seen.add(at)
        tags, at = _directory(data, at, e, big)
        yield _page(data, tags, e, len(seen) - 1, max_page_bytes)


def _directory(data: bytes, at: int, e: str, big: bool) -> tuple[dict[int, list[int]], int]:
    if at >= len(data):
        raise TiffError("a directory outside the file")
    (n,) = struct.unpack_from(f"{e}Q" if big else f"{e}H", data, at)
    at += 8 if big else 2
    tags: dict[int, list[int]] = {}
    if n * 12 > len(data):
        raise TiffError("directory longer than the file")
    for _ in range(n):
        tag, kind = struct.unpack_from(f"{e}HH", data, at)
        (count,) = struct.unpack_from(f"{e}Q" if big else f"{e}I", data, at + 4)
        size, slot = TYPE_SIZES.get(kind, 1) * count, at + (12 if big else 8)
        where = slot if size <= (8 if big else 4) else struct.unpack_from(f"{e}Q" if big else f"{e}I", data, slot)[0]
        if kind in TYPE_CODES:
            if where + size > len(data):
                raise TiffError("field outside the file")
            tags[tag] = list(struct.unpack_from(f"{e}{count}{TYPE_CODES[kind]}", data, where))
        at += 20 if big else 12
    return tags, struct.unpack_from(f"{e}Q" if big else f"{e}I", data, at)[0]


def _page(data: bytes, tags: dict[int, list[int]], e: str, index: int, max_page_bytes: int) -> Page:
    def one(tag: int, default: int) -> int:
        got = tags.get(tag) or [default]
        return got[0]

    width, height = one(WIDTH, 0), one(LENGTH, 0)
    samples, bits, scheme, predictor, planar, kind = one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    if width < 1 or height < 1 or samples < 1:
        raise TiffError("no size")
    if scheme not in DECODERS:
        raise TiffError(f"compression {scheme} is not supported")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, [bits]))) != 1:
        raise TiffError(f"{tags.get(BITS)} bits are not supported")
    if predictor not in (1, 2, 3) or predictor > 1 and bits < 8 or predictor == 3 and bits < 16:
        raise TiffError(f"predictor {predictor} is not supported for {bits} bits")
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h, offsets, counts = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        w, h, offsets, counts = width, min(height, one(ROWS_PER_STRIP, height)), tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS) or [len(data)]
    if w < 1 or h < 1:
        raise TiffError("strips or tiles without extent")
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    row_bytes = lambda n: -(-n * inner * bits // 8)
    if max(planes * height * row_bytes(width), h * row_bytes(w)) > min(max_page_bytes, DENSEST * len(data)):
        raise TiffError("the page is too large")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    bytes_ = max(1, bits // 8)
    whole = np.zeros((planes, height, row_bytes(width)), np.uint8)
    for i in range(across * down * planes):
        p, y, x = i // (across * down), i % (across * down) // across * h, i % across * w
        rows = h if tiled else min(h, height - y)
        raw = data[offsets[i] : offsets[i] + counts[i]]
        if one(FILL_ORDER, 1) == 2:
            raw = raw.translate(_MIRRORED)
        raw = DECODERS[scheme](raw, rows * row_bytes(w))
        if len(raw) < rows * row_bytes(w):
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8).reshape(rows, -1)
        if predictor == 2:
            unit = np.dtype(f"{e}u{bytes_}")
            block = np.add.accumulate(block.view(unit).reshape(rows, -1, inner), axis=1, dtype=unit.newbyteorder("=")).astype(unit).reshape(rows, -1).view(np.uint8)
        elif predictor == 3:
            # Differences of bytes; of each row first all highest bytes, then all next ones.
            sums = np.add.accumulate(block.reshape(rows, -1, inner), axis=1, dtype=np.uint8)
            swapped = sums.reshape(rows, bytes_, -1).transpose(0, 2, 1)
            block = np.ascontiguousarray(swapped if e == ">" else swapped[:, :, ::-1]).reshape(rows, -1)
        rows = min(rows, height - y)
        left, n = row_bytes(x), min(row_bytes(w), row_bytes(width) - row_bytes(x))
        whole[p, y : y + rows, left : left + n] = block[:rows, :n]
    if bytes_ > 1 and e == ">":
        whole = whole.view(f">u{bytes_}").astype(f"<u{bytes_}").view(np.uint8)
    if planes > 1:
        if bits < 8:
            raise TiffError("planes of samples under 8 bits are not supported")
        whole = whole.reshape(planes, height, width, -1).transpose(1, 2, 0, 3)
    return Page(index, width, height, samples, bits, scheme, predictor, kind, whole.tobytes())


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 480, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A classic TIFF of 8-bit or 16-bit pages (height x width or height x width x samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        kind = np.dtype(f"{order}u{a.dtype.itemsize}")
        height, width, samples = a.shape
        blocks = []
        if tile:
            h, w = tile
            for y in range(0, height, h):
                for x in range(0, width, w):
                    b = np.zeros((h, w, samples), a.dtype)
                    part = a[y : y + h, x : x + w]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            blocks = [a[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                d = b.copy()
                d[:, 1:] -= b[:, :-1]
                b = d
            packed = ENCODERS[compression](b.astype(kind, copy=False).tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8 * a.dtype.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, t, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODES[t]}", *values)
            if len(raw) > 4:
                entries += struct.pack(f"{order}HHII", tag, t, len(values), len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                entries += struct.pack(f"{order}HHI", tag, t, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(f"{order}H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


_PAGE = pa.schema([*((n, pa.int32()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor", "sample_format")), ("pixels", pa.binary()), ("tiff_error", pa.string())])
PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, sample_format int, pixels binary, tiff_error string"


def tiff_pages(media: DataFrame, column: str, batch_bytes: int = 1 << 25) -> DataFrame:
    """One row per page of the TIFF in `column`: the other columns, page, width, height, samples, bits, compression, predictor,
    sample_format (1 unsigned, 2 signed, 3 floating point), pixels (row-major, samples interleaved, little-endian) and tiff_error.

    Strips and tiles, classic and big files, both byte and fill orders; no compression, PackBits, LZW, deflate; predictors 1 to
    3; 1 to 64 bits, the same for all samples. Anything else, and null, empty or damaged bytes: the pages read before the
    fault, then one row with null page and the reason in tiff_error; so too for a page over 256 MB, which iter_tiff() takes
    with a larger max_page_bytes. Pages go on as they are read; a task holds one page over
    batch_bytes. Columns of media that have the name of an output column are dropped. Repeated rows: pages each. Empty table: no
    rows.
    """
    keep = [c for c in media.columns if c not in _PAGE.names and c != column]
    schema = StructType([*(media.schema[c] for c in keep), *StructType.fromDDL(PAGE)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            of: list[int] = []
            rows: list[tuple] = []

            def batch() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                made = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_PAGE)]
                out = pa.RecordBatch.from_arrays([*(rb.column(c).take(at) for c in keep), *made], names=[*keep, *_PAGE.names])  # noqa: B023
                of.clear()  # noqa: B023
                rows.clear()  # noqa: B023
                return out

            size = 0
            for i, x in enumerate(rb.column(column)):
                try:
                    for p in iter_tiff(x.as_py()):
                        of.append(i)
                        rows.append((p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.sample_format, p.pixels, None))
                        size += len(p.pixels)
                        if size > batch_bytes:
                            yield batch()
                            size = 0
                except TiffError as e:
                    of.append(i)
                    rows.append((*[None] * 9, str(e)))
            yield batch()

    return media.select(*keep, column).mapInArrow(decode, schema)


SIDE = 24
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def payload_pages(payload: np.ndarray, rows_a_page: int = 1440) -> list[np.ndarray]:
    image = payload.reshape(-1, SIDE)
    return [image[y : y + rows_a_page] for y in range(0, len(image), rows_a_page)]


def page_feature(pages: list[Page]) -> str:
    """Number of pages and rows, mean, mean absolute difference along rows, and shares of 8 grey bands in thousandths."""
    a = np.concatenate([np.frombuffer(p.pixels, np.uint8).reshape(p.height, -1) for p in pages])
    total = int(a.sum(dtype=np.int64))
    edge = int(np.maximum(a[:, 1:], a[:, :-1]).sum(dtype=np.int64) - np.minimum(a[:, 1:], a[:, :-1]).sum(dtype=np.int64))
    bands = np.bincount(a.ravel() >> 5, minlength=8) * 1000 // a.size
    return f"{len(pages)}p {a.shape[0]}x{a.shape[1]} m{total * 100 // a.size} e{edge * 100 // a.size} b{','.join(map(str, bands.tolist()))}"


def store_and_read(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Each text as a TIFF of 24-pixel rows, read back page by page, and features of the pages read. The text is padded with
    bytes 255 to a positive multiple of 576.

    Null text: as empty, one page of padding. Null doc_id: kept. Equal texts: equal values. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")}
            for i in range(len(off) - 1):
                raw = flat[off[i] : off[i + 1]]
                payload = np.full(max(1, -(-len(raw) // 576)) * 576, 255, np.uint8)
                payload[: len(raw)] = raw
                media = write_tiff(payload_pages(payload), compression, predictor)
                pages = read_tiff(media)
                back = b"".join(p.pixels for p in pages)
                for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), page_feature(pages), len(pages)), strict=True):
                    out[k].append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def op2_tiff_pages(spark, sf_dir):
    from lumaplan.llm.common import table

    return store_and_read(table(spark, sf_dir, "documents"))
