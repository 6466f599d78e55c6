"""Coders, records, slices and frames without Spark: literal values and round trips."""

import random
from dataclasses import replace

import numpy as np
import pytest

from lumaplan.operators.bits import BitReader, BitWriter, WindowedBitReader, crc32_msb
from lumaplan.operators.errors import CRC_MISMATCH, INVALID_ARGUMENT, INVALID_STATE, SYNTAX, UNSUPPORTED, CodecError
from lumaplan.operators.frames import bootstrap_result, decode_frame, decode_one, encode_frame, parse_frame, same_stream
from lumaplan.operators.legacy import encode_legacy_frame
from lumaplan.operators.golomb import Adaptive, Runs, read_code, write_code
from lumaplan.operators.range_coder import DEFAULT_TRANSITIONS, OldRangeDecoder, RangeDecoder, RangeEncoder, fresh_states
from lumaplan.operators.slices import Entropy, Header, Slice, banks_of, border, check_coverage, coded_planes, neighbours, plain_planes, residuals, row_order, with_footer, write_header
from lumaplan.operators.stream import GOLOMB, RANGE, RGB, QuantSet, StreamConfig, encoder_profile, grid, quant_set, read_record, subsampled, write_parameters, write_record


def fails(code, f, *a, **k):
    with pytest.raises(CodecError) as e:
        f(*a, **k)
    assert e.value.code == code
    return e.value


def test_crc():
    assert crc32_msb(b"123456789") == 0x89A1897F
    assert crc32_msb(bytes.fromhex("123456")) == 0x09FCFB57
    assert crc32_msb(b"any" + crc32_msb(b"any").to_bytes(4, "big")) == 0


def test_bits():
    w = BitWriter()
    for v, n in ((1, 1), (5, 3), (0, 7), (1023, 10), (0, 0)):
        w.bits(v, n)
    data = w.finish()
    for kind in (BitReader, WindowedBitReader):
        r = kind(data)
        assert [r.bits(n) for n in (1, 3, 7, 10)] == [1, 5, 0, 1023]
        assert r.left == 3
        fails(SYNTAX, r.bits, 4)
    rng = random.Random(1)
    fields = [(rng.getrandbits(n), n) for n in (rng.randrange(1, 30) for _ in range(400))]
    w = BitWriter()
    for f in fields:
        w.bits(*f)
    r = WindowedBitReader(w.finish())
    assert [r.bits(n) for _, n in fields] == [v for v, _ in fields]


def test_golomb_literals():
    def code(k, v, bits=8):
        w = BitWriter()
        write_code(w, k, bits, v)
        return w.finish().hex()

    assert [code(0, 0), code(0, 1), code(2, 0), code(2, 1), code(2, -3)] == ["80", "20", "80", "c0", "50"]
    assert code(0, -70) == "000800"
    for k in range(5):
        for v in range(-128, 128):
            w = BitWriter()
            write_code(w, k, 8, v)
            assert read_code(BitReader(w.finish()), k, 8) == v
    a = Adaptive(-4, 4, 0, 4)
    assert a.read(BitReader(b"\x80"), 8) == -1 and (a.drift, a.error_sum, a.bias, a.count) == (0, 5, -1, 5)
    a = Adaptive(-64, 256, 0, 128)
    a.learn(0)
    assert (a.drift, a.error_sum, a.bias, a.count) == (-32, 128, 0, 65)
    r = Runs()
    assert r.read(BitReader(b"\x80"), 8) == (1, False) and r.index == 1


def test_range_literals():
    for v, data in ((0, "0000"), (1, "7f80")):
        e = RangeEncoder()
        e.bit(bytearray([128]), 0, v)
        assert e.lower_bound().hex() == data
    assert len(DEFAULT_TRANSITIONS) == 256 and DEFAULT_TRANSITIONS[8] == 20 and DEFAULT_TRANSITIONS[128] == 134 and DEFAULT_TRANSITIONS[248] == 248 and not any(DEFAULT_TRANSITIONS[249:])


@pytest.mark.parametrize("closing", ["closed", "lower_bound"])
def test_range_round_trip(closing):
    rng = random.Random(4)
    for _ in range(60):
        values = [rng.choice([0, 0, 1, -1, rng.randrange(-300, 300), rng.randrange(-(2**62), 2**62)]) for _ in range(rng.randrange(200))]
        e, s = RangeEncoder(), fresh_states(3)
        for i, v in enumerate(values):
            e.symbol(s[i % 3], v, True)
        d, s = RangeDecoder(getattr(e, closing)()), fresh_states(3)
        assert [d.symbol(s[i % 3], True) for i in range(len(values))] == values
    fails(SYNTAX, RangeDecoder, b"\0")
    fails(INVALID_ARGUMENT, RangeEncoder().symbol, bytearray([128] * 32), -1, False)


def test_colour_literals():
    one = lambda *v: [np.array([[x]]) for x in v]
    for bits, extra, rgb, coded in ((8, False, (200, 100, 50), (112, 206, 356)), (10, False, (900, 700, 100), (450, 1624, 1824)), (10, True, (900, 700, 100), (600, 424, 1224))):
        c = StreamConfig(1, 1, bits, RGB, True, extra)
        assert [int(p[0, 0]) for p, _ in coded_planes(c, one(*rgb))][:3] == list(coded)
        assert [int(p[0, 0]) for p in plain_planes(c, one(*coded))] == list(rgb)
    c = StreamConfig(1, 1, 8, RGB, True)
    assert [int(p[0, 0]) for p in plain_planes(c, one(127, 1, 1))] == [0, 255, 0] and [int(p[0, 0]) for p in plain_planes(c, one(0, 0, 0))] == [128, 128, 128]


def test_neighbours_against_a_loop():
    s = np.random.default_rng(1).integers(1, 255, (9, 13))
    n = neighbours(s)
    at = lambda y, x: int(s[y, x]) if 0 <= y and 0 <= x else 0
    for y in range(9):
        for x in range(13):
            want = {
                "left": at(y, x - 1) if x else at(y - 1, 0), "top": at(y - 1, x), "top_left": at(y - 1, x - 1) if x else at(y - 2, 0), "top_right": at(y - 1, min(x + 1, 12)),
                "far_left": at(y, x - 2) if x > 1 else at(y - 1, 0) if x == 1 else 0, "top_top": at(y - 2, x),
            }
            assert {k: int(v[y, x]) for k, v in n.items()} == want


def test_context_literals():
    t = [[0] * 256 for _ in range(5)]
    for i, v in enumerate((1, 2, 4, 8, 16)):
        t[i][i + 1] = v
    n = {"far_left": 17, "left": 13, "top": 10, "top_left": 12, "top_right": 7, "top_top": 15}
    g = [n["left"] - n["top_left"], n["top_left"] - n["top"], n["top"] - n["top_right"], n["far_left"] - n["left"], n["top_top"] - n["top"]]
    assert sum(t[i][v & 255] for i, v in enumerate(g)) == 31


def test_geometry():
    assert [grid(1, 17, 4), grid(2, 17, 4) - grid(1, 17, 4)] == [4, 4]
    assert [subsampled(5, 1), subsampled(4, 1), subsampled(1, 40), subsampled(0, 40)] == [3, 2, 1, 0]
    c = StreamConfig(17, 10, num_h=4, num_v=3)
    assert c.cell(0, 1, 1, 2, 1)[:3] == (4, 3, 8) and c.cell(0, 3, 1, 1, 2) == (12, 3, 5, 7)
    assert [StreamConfig(4, 4, extra=True, version=v).slot(1) for v in (3, 4)] == [2, 1]


@pytest.mark.parametrize("change,code", [({"bits": 0}, UNSUPPORTED), ({"bits": 17}, UNSUPPORTED), ({"width": 0}, INVALID_ARGUMENT), ({"version": 1}, UNSUPPORTED), ({"colorspace": RGB}, INVALID_ARGUMENT), ({"log2_h": 1}, INVALID_ARGUMENT), ({"chroma": True, "log2_v": 1}, UNSUPPORTED), ({"num_h": 0}, INVALID_ARGUMENT), ({"num_h": 99}, INVALID_ARGUMENT), ({"width": 400, "height": 300}, INVALID_ARGUMENT), ({"entropy": "x"}, UNSUPPORTED)])
def test_encoder_profile_refuses(change, code):
    fails(code, encoder_profile, StreamConfig(**{"width": 16, "height": 8} | change))


def frames_of(c, rng, n=3):
    out = []
    for k in range(n):
        planes = []
        for p in range(c.planes):
            w, h = c.plane_size(p)
            a = np.add.outer(np.arange(h) * 3, np.arange(w) * 7) + k * 5 + (rng.integers(0, 3, (h, w)) if k else 0)
            planes.append((rng.integers(0, 1 << c.bits, (h, w)) if k == 2 else a) & ((1 << c.bits) - 1))
        out.append(planes)
    return out


@pytest.mark.parametrize("entropy", [RANGE, GOLOMB])
@pytest.mark.parametrize("bits", [1, 2, 7, 8, 9, 10, 12, 15, 16])
@pytest.mark.parametrize("kind", [(0, False, False, 0, 0), (0, True, False, 0, 0), (0, True, True, 1, 1), (0, True, False, 1, 0), (0, False, True, 0, 0), (1, True, False, 0, 0), (1, True, True, 0, 0)])
@pytest.mark.parametrize("grid_", [(1, 1, False), (2, 2, True)])
def test_frames_round_trip(entropy, bits, kind, grid_):
    cs, chroma, extra, lh, lv = kind
    c = encoder_profile(StreamConfig(9, 7, bits, cs, chroma, extra, lh, lv, grid_[0], grid_[1], entropy, grid_[2]), 3)
    c2 = read_record(write_record(c), 9, 7)
    assert c2 == c
    states = back = None
    for k, planes in enumerate(frames_of(c, np.random.default_rng(bits))):
        data, states = encode_frame(c, planes, k == 0, states)
        out, key, back = decode_frame(c2, data, back)
        assert key == (k == 0) and all((a == b).all() for a, b in zip(planes, out, strict=True))


@pytest.mark.parametrize("entropy", [RANGE, GOLOMB])
def test_contexts_initial_states_and_free_slices(entropy):
    rng = np.random.default_rng(3)
    q = quant_set([1, 2, 3, 122], [1, 4, 123], [2, 5, 121], [128], [128])
    first = tuple(bytes(rng.integers(60, 200, 32).astype(np.uint8)) for _ in range(q.contexts))
    moved = DEFAULT_TRANSITIONS if entropy == GOLOMB else bytes([0, *(min(255, x + (i % 3 == 0 and 8 < i < 240)) for i, x in enumerate(DEFAULT_TRANSITIONS[1:], 1))])
    c = StreamConfig(40, 30, 8, num_h=2, num_v=2, entropy=entropy, quant_sets=(q, QuantSet()), initial=(first, None), transitions=moved)
    assert read_record(write_record(c), 40, 30) == c
    a = np.cumsum(rng.integers(-3, 4, (30, 40)), 1) & 255
    headers = [Header(0, 0, 2, 1, (0, 1)), Header(0, 1, 1, 1, (1, 0)), Header(1, 1, 1, 1, (0, 0), 2, (4, 3))]
    data, _ = encode_frame(c, [a], True, None, headers)
    out, _, _ = decode_frame(c, data)
    assert (out[0] == a).all()
    assert [s.header for s in parse_frame(c, data).slices] == headers


def test_footer():
    assert with_footer(StreamConfig(4, 4), b"\xaa\xbb").hex() == "aabb000002"
    data = with_footer(StreamConfig(4, 4, ec=True), b"\xaa\xbb", 2)
    assert len(data) == 10 and crc32_msb(data) == 0


def test_coverage_faults():
    c = StreamConfig(64, 64, num_h=2, num_v=2)
    s = lambda *r: [Slice(i, b"", 0, 0, 0, 0, Header(*x, (0, 0))) for i, x in enumerate(r)]
    check_coverage(c, s((0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)))
    fails(SYNTAX, check_coverage, c, s((0, 0, 1, 2), (1, 0, 1, 1)))
    fails(SYNTAX, check_coverage, c, s((0, 0, 2, 1), (1, 0, 1, 2), (0, 1, 1, 1)))
    big = StreamConfig(400, 300, num_h=2, num_v=2)
    fails(SYNTAX, check_coverage, big, s((0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)))


def test_damage_is_told():
    c = encoder_profile(StreamConfig(16, 8, num_h=2, num_v=2, ec=True), 2)
    f0, f1 = ([np.arange(128).reshape(8, 16) * m & 255] for m in (37, 19))
    data, states = encode_frame(c, f0, True)
    second, _ = encode_frame(c, f1, False, states)
    bad = bytearray(data)
    bad[-12] ^= 1
    e = fails(CRC_MISMATCH, decode_frame, c, bytes(bad))
    assert e.slice_index == 3
    fails(INVALID_STATE, decode_frame, c, second)
    fails(INVALID_STATE, encode_frame, c, f1, False)
    fails(INVALID_ARGUMENT, decode_frame, c, b"")
    fails(SYNTAX, decode_frame, c, data[1:])
    status = bytearray(data)
    status[-5] = 3
    fails(SYNTAX, parse_frame, c, bytes(status), False)
    over = [np.full((8, 16), 256)]
    assert fails(INVALID_ARGUMENT, encode_frame, c, over).slice_index == 0
    fails(INVALID_ARGUMENT, encode_frame, c, [np.zeros((8, 15), int)])
    fails(CRC_MISMATCH, read_record, write_record(c)[:-1] + b"\0")
    intra = encoder_profile(c, 1)
    fails(SYNTAX, decode_frame, intra, second)


def test_noise_never_breaks_the_decoder():
    rng = random.Random(5)
    for entropy in (RANGE, GOLOMB):
        c = encoder_profile(StreamConfig(16, 16, entropy=entropy))
        good, _ = encode_frame(c, [np.arange(256).reshape(16, 16)])
        for _ in range(150):
            bad = bytearray(good if rng.random() < 0.7 else rng.randbytes(rng.randrange(1, 80)))
            for _ in range(3):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            try:
                decode_frame(c, bytes(bad))
            except CodecError:
                pass
            try:
                read_record(bytes(bad))
            except CodecError:
                pass


def legacy_frame(c, planes, key=True, embed=True, state=None):
    """A frame of version 0 or 1, written by the rules that the decoder reads by (no zero-symbol carry: RGB only, or Golomb-Rice)."""
    w = RangeEncoder()
    if c.entropy == GOLOMB:
        from lumaplan.operators.slices import _golomb_row

        out = BitWriter()
        if embed:
            w.bit(bytearray([128]), 0, int(key))
            write_parameters(c, w, fresh_states(32))
            head = w.lower_bound()
        else:
            head = b""
            out.bits(int(key), 1)
    else:
        w.bit(bytearray([128]), 0, int(key))
        if key and embed:
            write_parameters(c, w, fresh_states(32))
        w.one, w.zero = RangeEncoder(c.transitions).one, RangeEncoder(c.transitions).zero
    header = Header(0, 0, 1, 1, (0,) * c.slots)
    sets, bank, qset = banks_of(c, header)
    state = state or Entropy.fresh(c, sets)
    coded = coded_planes(c, planes)
    parts = [(*residuals(c, s, bits, c.quant_sets[0]), bits) for s, bits in coded]
    runs = [Runs() for _ in coded]
    for p, y in row_order(c, [s.shape[0] for s, _ in coded]):
        assert border(c, p) == 0
        if c.entropy == GOLOMB:
            _golomb_row(out, runs[0 if c.colorspace == RGB else p], state.banks[bank[p]], parts[p][0][y].tolist(), parts[p][1][y].tolist(), parts[p][2])
        else:
            for k, d in zip(parts[p][0][y].tolist(), parts[p][1][y].tolist(), strict=True):
                w.symbol(state.banks[bank[p]][k], d, True)
    return (head + out.finish() if c.entropy == GOLOMB else w.closed()), state


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("entropy,colorspace", [(RANGE, RGB), (GOLOMB, RGB), (GOLOMB, 0)])
@pytest.mark.parametrize("embed", [True, False])
def test_legacy_frames(version, entropy, colorspace, embed):
    c = StreamConfig(11, 6, 8, colorspace, colorspace == RGB, version=version, micro=0, entropy=entropy, intra=False)
    rng = np.random.default_rng(2)
    planes = [np.cumsum(rng.integers(-4, 5, (6, 11)), 1) & 255 for _ in range(c.planes)]
    data, state = legacy_frame(c, planes, embed=embed)
    out, key, kept = decode_frame(c, data)
    assert key and all((a == b).all() for a, b in zip(planes, out, strict=True))
    nxt, _ = legacy_frame(c, planes[::-1], False, False, state)
    out, key, _ = decode_frame(c, nxt, kept)
    assert not key and all((a == b).all() for a, b in zip(planes[::-1], out, strict=True))
    if embed:
        result, found = bootstrap_result(None, data, 11, 6)
        assert result == "configured" and same_stream(found, c)
        assert bootstrap_result(c, data, 11, 6)[0] == "matches"
        other = StreamConfig(11, 6, 8, 0, False, version=version, micro=0, entropy=GOLOMB if entropy == RANGE else RANGE, intra=False)
        assert bootstrap_result(other, data, 11, 6)[0] == "differs"


def test_legacy_grid_headers():
    c = StreamConfig(12, 8, num_h=2, num_v=2, version=1, micro=0, intra=False)
    headers = [Header(0, 0, 2, 1, (0, 0)), Header(0, 1, 1, 1, (0, 0)), Header(1, 1, 1, 1, (0, 0))]
    w = RangeEncoder()
    w.bit(bytearray([128]), 0, 1)
    for h in headers:
        write_header(w, c, h)
    frame = parse_frame(c, w.closed() + bytes(8))
    assert frame.keyframe and [s.header for s in frame.slices] == headers
    assert [s.content for s in frame.slices] == sorted(s.content for s in frame.slices)
    fails(UNSUPPORTED, parse_frame, StreamConfig(12, 8, num_h=2, version=0, micro=0, entropy=GOLOMB), b"\x80\0\0")
    w = RangeEncoder()
    w.bit(bytearray([128]), 0, 1)
    for h in (headers[0], headers[0]):
        write_header(w, c, h)
    fails(SYNTAX, parse_frame, c, w.closed() + bytes(8))


def test_old_arithmetic_by_hand():
    # State 128 of range 0xff00: both shares are exact, so the old coder reads as the new one.
    assert OldRangeDecoder(b"\x7f\x80").bit(bytearray([128]), 0) == RangeDecoder(b"\x7f\x80").bit(bytearray([128]), 0) == 1
    d = OldRangeDecoder(b"\xfe\xff\x00")
    d.range = 0xFF01
    # 0xff01 * 100 / 256 = 25500.39, rounded up 25501; the rest is 39780; both shares were rounded, so low gains 2.
    assert d.bit(bytearray([100]), 0) == 1 and d.range == 25501 and d.low == 0xFEFF - 39780 + 2


def test_a_header_that_is_not_the_descriptors():
    from lumaplan.operators.codec import _reparsed

    c = StreamConfig(12, 8, num_h=2)
    data, _ = encode_frame(c, [np.zeros((8, 12), np.uint8)])
    first = parse_frame(c, data).slices[0]
    row = {"payload": data[: first.footer + 3], "slice_index": 0, "raster_x": 0, "raster_y": 0, "raster_w": 1, "raster_h": 1}
    assert _reparsed(c, row).header == first.header
    fails(SYNTAX, _reparsed, c, row | {"raster_x": 1})


def test_options():
    from lumaplan.operators.options import DecoderOptions, EncoderOptions

    assert DecoderOptions(2, False, True, 4, 5).checked().width == 4 and EncoderOptions(keyframe_interval=3).checked().version == 3
    fails(INVALID_ARGUMENT, DecoderOptions(threads=-1).checked)
    fails(UNSUPPORTED, DecoderOptions(strict=False).checked)
    fails(INVALID_ARGUMENT, DecoderOptions(width=4).checked)
    fails(INVALID_ARGUMENT, EncoderOptions(threads=-1).checked)
    fails(INVALID_ARGUMENT, EncoderOptions(keyframe_interval=0).checked)


def test_old_arithmetic_is_used_where_content_goes_on():
    """The first symbol in the old arithmetic starts from state 255, so a zero is read nearly for free."""
    from lumaplan.operators.slices import Slice, decode_slice

    c = StreamConfig(3, 1, version=0, micro=0, intra=False)
    data = bytes([0xFE, 0x80, 0, 0, 0, 0])
    s = Slice(0, data, 0, 2, len(data), 0, Header(0, 0, 1, 1, (0, 0)), arithmetic=RangeDecoder(data).state(), old=True)
    out, state = decode_slice(c, s, None)
    r = OldRangeDecoder(data)
    r.zero_symbol_carry = True
    states = fresh_states(1)
    states[0][0] = 255
    diffs = [r.symbol(states[0], True) for _ in range(3)]
    assert out[0].tolist() == [[sum(diffs[: i + 1]) & 255 for i in range(3)]] and state.banks[0] == states
    assert (decode_slice(c, s.__class__(**{**s.__dict__, "old": False}), None)[1].banks[0] != states)


@pytest.mark.parametrize("kind", ["noise", "smooth", "short"])
def test_arithmetics_that_add_to_low(kind):
    """Legacy range coded YCbCr, and the oldest arithmetic: what is written comes back; what no stream says is refused, most of it
    smooth samples, and almost all but a few samples in the oldest arithmetic."""
    rng = np.random.default_rng(12)
    cases = [
        (StreamConfig(10, 8, chroma=True, version=1, micro=0, intra=False), False),
        (StreamConfig(11, 7, chroma=True, log2_h=1, log2_v=1, version=0, micro=0, intra=False), False),
        (StreamConfig(6, 2, version=0, micro=0, intra=False, transitions=bytes([0, *(v or min(254, s + 1) for s, v in enumerate(DEFAULT_TRANSITIONS[1:], 1))])), True),
    ]
    done = [0, 0, 0]
    for n, (c, old) in enumerate(cases):
        state = back = None
        for f in range(30):
            planes = [rng.integers(0, 256, c.plane_size(p)[::-1]) if kind == "noise" else np.cumsum(rng.integers(-9 if kind == "short" else -2, 9 if kind == "short" else 3, c.plane_size(p)[::-1]), 1) + 100 & 255 for p in range(c.planes)]
            key = state is None
            try:
                data, state = encode_legacy_frame(c, planes, key, f % 2 == 0, state, old, spelled=f % 4 == 0)
            except CodecError as e:
                assert e.code == INVALID_ARGUMENT
                state = back = None
                continue
            (s,) = parse_frame(c, data).slices
            got, back = decode_one(c, replace(s, old=old), None if key else back)
            assert all((a == b).all() for a, b in zip(planes, got, strict=True))
            done[n] += 1
    assert done[0] >= 20 and done[1] >= 20 and done[2] >= 5


@pytest.mark.parametrize("c", [StreamConfig(22, 20, chroma=True, version=1, micro=0, intra=False), StreamConfig(64, 20, chroma=True, log2_h=1, log2_v=1, version=0, micro=0, intra=False)])
def test_keyframes_with_other_transitions(c):
    """Samples that the stream's own state transitions leave no value for; frames up to the next keyframe go on with the others, also
    from states that a streaming query has stored, and that keyframe with the stream's own."""
    from lumaplan.operators.legacy import other_transitions
    from lumaplan.streaming.stateful import dump, load
    from lumaplan.streaming.transactions import dump_state, load_state

    rng, hard = np.random.default_rng(5), 0
    walk = lambda step: [np.cumsum(rng.integers(-step, step + 1, c.plane_size(p)[::-1]), 1) + 100 & 255 for p in range(c.planes)]

    def written(planes, *args):
        try:
            return encode_legacy_frame(c, planes, *args)
        except CodecError as e:
            assert e.code == INVALID_ARGUMENT

    for _ in range(40):
        first, then, last = walk(1), walk(9), walk(90)
        if any(written(first, True, *way) for way in ((False,), (True,), (True, None, False, True))):
            continue
        found = next((f for t in other_transitions() if (f := written(first, True, True, None, False, False, t))), None)
        after = found and written(then, False, False, found[1])
        end = written(last, True, False)
        if not after or not end:
            continue
        assert bootstrap_result(c, found[0], c.width, c.height)[0] == "differs"
        state = None
        for data, planes, key in ((found[0], first, True), (after[0], then, False), (end[0], last, True)):
            states = [None] if key else [state, load(dump(state)), load_state(c, (0,) * c.planes, dump_state(c, state))]
            for s in states:
                out, is_key, kept = decode_frame(c, data, s and {(0, 0, 1, 1): s})
                assert is_key == key and all((a == b).all() for a, b in zip(planes, out, strict=True))
            (state,) = kept.values()
            assert (state.transitions is None) == (planes is last)
        hard += 1
    assert hard >= 3
    fails(INVALID_ARGUMENT, encode_legacy_frame, c, first, True, False, None, False, False, other_transitions()[0])
