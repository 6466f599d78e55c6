import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from fixtures import SCHEMA, rows

from lumaplan.llm import media_tiff as m


@pytest.mark.parametrize("scheme", [m.NONE, m.LZW, m.DEFLATE, m.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(scheme, predictor, order, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (37, 41), np.uint8), rng.integers(0, 65536, (20, 33, 3)).astype(np.uint16), np.zeros((300, 50), np.uint8), rng.integers(0, 256, (130, 100), np.uint8)]
    got = m.read_tiff(m.write_tiff(pages, scheme, predictor, 7, tile, order))
    assert [p.index for p in got] == [0, 1, 2, 3]
    for p, a in zip(got, pages, strict=True):
        assert (p.width, p.height, p.bits) == (a.shape[1], a.shape[0], 8 * a.itemsize)
        assert p.pixels == a.astype(f"<u{a.itemsize}").tobytes()


def test_codecs():
    rng = random.Random(2)
    for n in (0, 1, 2, 127, 128, 129, 5000, 70000):
        for alphabet in (1, 2, 256):
            d = bytes(rng.randrange(alphabet) for _ in range(n))
            assert m.unpack_bits(m.pack_bits(d), n) == d
            assert m.lzw_decode(m.lzw_encode(d), n) == d
    # The example of the PackBits description.
    assert m.unpack_bits(bytes.fromhex("feaa028000 2afdaa03800 02a22f7aa".replace(" ", "")), 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")


def test_damaged():
    good = m.write_tiff([np.zeros((9, 9), np.uint8)])
    for bad in (None, b"", b"II", b"GIF89a..", good[:20], good[:-10], b"II\x2a\0\xff\xff\xff\x7f", good.replace(b"\x2a\0", b"\x2b\0", 1)):
        with pytest.raises(m.TiffError):
            m.read_tiff(bad)
    for i in range(len(good)):
        for v in (0, 255, good[i] ^ 1):
            try:
                m.read_tiff(good[:i] + bytes((v,)) + good[i + 1 :])
            except m.TiffError:
                pass


def packed_codes(codes, width=9):
    bits = "".join(f"{c:0{width}b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def by_hand(order, compression, data, width, height, *more, bits=8):
    """A file with one strip, laid out here and not by write_tiff(): header, strip, directory."""
    fields = [(256, 3, width), (257, 3, height), (258, 3, bits), (259, 3, compression), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, height), (279, 4, len(data)), *more]
    data += b"\0" * (len(data) % 2)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data)) + data
    out += struct.pack(order + "H", len(fields))
    for tag, kind, value in sorted(fields):
        out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return out + bytes(4)


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_by_hand(order):
    """The examples of the format's description (LZW codes, PackBits) and a stored deflate block."""
    nine = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    lzw = packed_codes([256, 7, 258, 8, 8, 258, 6, 6, 257])
    deflate = b"\x78\x01\x01\x09\x00\xf6\xff" + nine + zlib.adler32(nine).to_bytes(4, "big")
    for compression, data in ((1, nine), (5, lzw), (8, deflate), (32946, deflate), (32773, bytes([254, 7, 0xFF, 8, 0xFF, 7, 0xFF, 6]))):
        (page,) = m.read_tiff(by_hand(order, compression, data, 3, 3))
        assert page.pixels == nine and (page.width, page.height, page.compression) == (3, 3, compression)
        mirrored = bytes(int(f"{b:08b}"[::-1], 2) for b in data)
        assert m.read_tiff(by_hand(order, compression, mirrored, 3, 3, (266, 3, 2)))[0].pixels == nine
    bits = bytes.fromhex("feaa028000 2afdaa0380002a22f7aa".replace(" ", ""))
    assert m.read_tiff(by_hand(order, 32773, bits, 192, 1, bits=1))[0].pixels == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert m.read_tiff(by_hand(order, 1, bytes([1, 1, 1, 250, 0, 7]), 3, 2, (317, 3, 2)))[0].pixels == bytes([1, 2, 3, 250, 250, 1])
    # Floating-point predictor: highest bytes of the row first, then differences of bytes.
    values = np.array([[1.5, -2.25, 3e7], [0.0, 1e-9, 5.0]], ">f4")
    rows = []
    for r in values:
        high_first = bytes(struct.pack(">f", v)[k] for k in range(4) for v in r)
        rows.append(bytes((a - b) & 255 for a, b in zip(high_first, b"\0" + high_first, strict=False)))
    (page,) = m.read_tiff(by_hand(order, 1, b"".join(rows), 3, 2, (317, 3, 3), (339, 3, 3), bits=32))
    assert page.sample_format == 3 and page.pixels == values.astype("<f4").tobytes()


def test_fuzz():
    """10,000 mutated files: pages or TiffError, nothing else."""
    rng = random.Random(5)
    a = np.arange(40 * 33, dtype=np.uint16).reshape(40, 33) % 251
    files = [m.write_tiff([a.astype(np.uint8), a, np.stack([a, a, a], 2)], scheme, predictor, 7, tile, order) for scheme in (m.NONE, m.LZW, m.DEFLATE, m.PACKBITS) for predictor in (1, 2) for tile in (None, (16, 16)) for order in "<>"]
    read = 0
    for i in range(10_000):
        f = bytearray(files[i % len(files)])
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(4)
            at = rng.randrange(len(f)) if rng.random() < 0.5 else max(0, len(f) - 1 - rng.randrange(170))
            if kind == 0:
                f[at] = rng.choice([0, 1, 255, rng.randrange(256)])
            elif kind == 1:
                f[at : at + 4] = struct.pack(rng.choice("<>") + "I", rng.choice([0, 1, len(f), 2**31, 2**32 - 1]))
            elif kind == 2:
                del f[at:]
            else:
                f[at : at + 2] = struct.pack(rng.choice("<>") + "H", rng.choice([0, 3, 256, 257, 258, 259, 277, 278, 284, 317, 322, 323]))
            if not f:
                break
        try:
            read += len(list(m.iter_tiff(bytes(f))))
        except m.TiffError:
            pass
    assert read > 1000


def test_good_pages_before_a_bad_one(spark):
    two = m.write_tiff([np.full((3, 4), 7, np.uint8), np.full((5, 5), 9, np.uint8)], m.NONE)
    bad = two.replace(struct.pack("<HHII", m.WIDTH, 4, 1, 5), struct.pack("<HHII", m.WIDTH, 4, 1, 0))
    assert bad != two
    got = m.tiff_pages(spark.createDataFrame([(1, bad), (2, two)], "id int, media binary"), "media", batch_bytes=1).collect()
    assert sorted((r["id"], -1 if r["page"] is None else r["page"], r["tiff_error"]) for r in got) == [(1, -1, "no size"), (1, 0, None), (2, 0, None), (2, 1, None)]


def plain_feature(payload):
    """The feature from its definition, byte by byte."""
    n, rows = len(payload), [payload[i : i + 24] for i in range(0, len(payload), 24)]
    edge = sum(abs(r[i + 1] - r[i]) for r in rows for i in range(23))
    bands = [sum(b // 32 == k for b in payload) * 1000 // n for k in range(8)]
    return f"{-(-len(rows) // 1440)}p {len(rows)}x24 m{sum(payload) * 100 // n} e{edge * 100 // n} b{','.join(map(str, bands))}"


def test_pages(spark):
    two = m.write_tiff([np.full((3, 4), 7, np.uint8), np.arange(6, dtype=np.uint8).reshape(2, 3)])
    got = m.tiff_pages(spark.createDataFrame([(1, two, "c"), (2, None, "c"), (3, b"no", "c"), (1, two, "c")], "id int, media binary, pixels string"), "media").collect()
    assert sorted((r["id"], r["page"] if r["page"] is not None else -1) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, -1), (3, -1)]
    assert all((r["tiff_error"] is None) == (r["id"] == 1) for r in got)
    assert {bytes(r["pixels"]) for r in got if r["page"] == 1} == {bytes(range(6))}


def test_store_and_read(spark):
    got = m.store_and_read(spark.createDataFrame(rows(), SCHEMA)).collect()
    want = []
    for d, t, *_ in rows():
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), plain_feature(p)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(want, key=key) == sorted(((*tuple(r)[:5], r["feature"]) for r in got), key=key)
    values = {}
    for r in got:
        assert values.setdefault(r["payload_sha256"], tuple(r)[5:]) == tuple(r)[5:]
