"""Lockstep lanes against the serial coder, which is the definition."""

import itertools
import random

import numpy as np
import pytest

from lumaplan.operators.bits import POLYNOMIAL, crc32_msb
from lumaplan.operators.frames import decode_one, parse_frame
from lumaplan.operators.lanes import bit_length, decode_frames, encode_frames
from lumaplan.operators.range_coder import DEFAULT_TRANSITIONS
from lumaplan.operators.slices import Header, encode_slice
from lumaplan.operators.stream import GOLOMB, RANGE, RGB, YCBCR, QuantSet, StreamConfig


def tables(seed, contexts=True):
    rng = random.Random(seed)
    if not contexts:
        return QuantSet()
    scale, out = 1, []
    for levels in (3, 2, 2, 1, 1):
        cut = sorted(rng.sample(range(1, 100), levels))
        t = [sum(v >= x for x in cut) * scale for v in range(128)]
        out.append(tuple([*t, *(-t[min(255 - v, 127)] if v > 128 else -t[127] for v in range(128, 256))]))
        scale *= 2 * levels + 1
    return QuantSet(tuple(out), (scale + 1) // 2)


def planes_of(c, rng, kind):
    out = []
    for p in range(c.planes):
        w, h = c.plane_size(p)
        top = 1 << c.bits
        if kind == "noise":
            a = rng.integers(0, top, (h, w))
        elif kind == "flat":
            a = np.where(rng.random((h, w)) < 0.04, rng.integers(0, top, (h, w)), top // 3)
        else:
            a = np.add.outer(np.arange(h), np.arange(w)) * max(1, top // 64) + rng.integers(0, max(1, top // 32), (h, w))
        out.append(a % top)
    return out


def serial(c, header, first, frames):
    state, out = None, []
    for f, planes in enumerate(frames):
        data, state = encode_slice(c, planes, header, f == 0 if first else None, None if f == 0 else state)
        out.append(data)
    return out


CASES = [
    (entropy, bits, cs, chroma, extra, lh, lv, q)
    for entropy, (bits, cs, chroma, extra, lh, lv), q in itertools.product(
        (RANGE, GOLOMB), ((8, YCBCR, False, False, 0, 0), (1, YCBCR, False, False, 0, 0), (10, YCBCR, True, True, 1, 1), (16, YCBCR, False, False, 0, 0), (8, RGB, True, False, 0, 0), (10, RGB, True, True, 0, 0), (16, RGB, True, False, 0, 0)), (False, True)
    )
]


@pytest.mark.parametrize("case", CASES)
def test_lanes_are_the_serial_coder(case):
    entropy, bits, cs, chroma, extra, lh, lv, many = case
    rng = np.random.default_rng(abs(hash(str(case))) % 2**32)
    q = tables(5, many)
    moved = bytes([0, *(min(255, v + (v < 200)) for v in DEFAULT_TRANSITIONS[1:])]) if many else DEFAULT_TRANSITIONS
    c = StreamConfig(13, 9, bits, cs, chroma, extra, lh, lv, entropy=entropy, ec=True, intra=False, quant_sets=(q, QuantSet()), transitions=moved if entropy == RANGE else DEFAULT_TRANSITIONS)
    header = Header(0, 0, 1, 1, (0, 1, 0)[: c.slots])
    chains = [[planes_of(c, rng, ("noise", "flat", "slope")[i % 3]) for _ in range(1 + i % 3)] for i in range(20)]
    first = [i % 4 > 0 for i in range(20)]
    want = [serial(c, header, k, x) for k, x in zip(first, chains, strict=True)]
    assert encode_frames(c, [header] * 20, first, chains) == want
    back = decode_frames(c, [[s for d in x for s in parse_frame(c, d).slices] for k, x in zip(first, want, strict=True) if k])
    for planes, got in zip([x for k, x in zip(first, chains, strict=True) if k], back, strict=True):
        assert got is not None and all((a == b).all() for f, g in zip(planes, got, strict=True) for a, b in zip(f, g, strict=True))


@pytest.mark.parametrize("entropy", [RANGE, GOLOMB])
def test_lanes_with_faults_are_left_to_the_serial_coder(entropy):
    rng = np.random.default_rng(8)
    c = StreamConfig(12, 8, 8, entropy=entropy, intra=False, quant_sets=(tables(6),))
    header = Header(0, 0, 1, 1, (0, 0))
    chains = [[planes_of(c, rng, "slope"), planes_of(c, rng, "flat")] for _ in range(16)]
    chains[3][1][0][2, 2] = 256
    coded = encode_frames(c, [header] * 16, [True] * 16, chains)
    assert coded[3] is None and all(coded[i] == serial(c, header, True, chains[i]) for i in range(16) if i != 3)
    whole = [x for x in coded if x]
    damaged, fates = [], []
    for n, x in enumerate(whole * 12):
        d = bytearray(x[0][:-3])
        for _ in range(n % 5):
            d[rng.integers(4, len(d))] ^= 1 << rng.integers(8)
        d = d[: len(d) - n % 3]
        damaged.append(parse_frame(c, bytes(d) + len(d).to_bytes(3, "big")).slices[0])
        try:
            fates.append(decode_one(c, damaged[-1], None)[0])
        except Exception:
            fates.append(None)
    got = decode_frames(c, [[s] for s in damaged])
    for f, g in zip(fates, got, strict=True):
        # A lane may give up what the serial coder still decodes, but what it gives is that coder's.
        assert g is None or f is not None and all((a == b).all() for a, b in zip(f, g[0], strict=True))
    whole_ones = [g for n, g in enumerate(got) if n % 5 == 0 and n % 3 == 0]
    assert all(g is not None for g in whole_ones) and sum(g is None for g in got) < len(got)


def test_crc_by_the_polynomial():
    def plain(data, r=0):
        for byte in data:
            r ^= byte << 24
            for _ in range(8):
                r = (r << 1 ^ (POLYNOMIAL if r >> 31 else 0)) & 0xFFFFFFFF
        return r

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 9, 100):
        data, start = rng.randbytes(n), rng.getrandbits(32)
        assert crc32_msb(data) == plain(data) and crc32_msb(data, start) == plain(data, start)
        assert crc32_msb(data + crc32_msb(data).to_bytes(4, "big")) == 0


def test_bit_length():
    v = np.array([0, 1, 2, 3, 255, 256, 2**31, 2**40 - 1])
    assert bit_length(v).tolist() == [int(x).bit_length() for x in v]


def test_lanes_at_once_are_bounded_by_their_samples():
    from lumaplan.operators.codec import _together
    from lumaplan.operators.lanes import FEWEST, lanes_at_once

    c = StreamConfig(64, 20)
    assert lanes_at_once(c, (0,), 1280) * 1280 <= 1 << 19
    assert lanes_at_once(c, (0,), 352 * 288) < FEWEST
    parts = list(_together([("k",)] * 4096, lambda k: (c, (0,), 1280)))
    assert sorted(i for p in parts for i in p) == list(range(4096)) and max(map(len, parts)) * 1280 <= 1 << 19
