"""Prediction, colour transform, contexts and geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_shift(v: Column, s: int) -> Column:
    """Floor of v / 2**s, also for negative v."""
    return F.shiftright(v, s)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def wrap_difference(v: Column, bits: int) -> Column:
    """v modulo 2**bits in [-2**(bits-1), 2**(bits-1)); bits 0 or over 30: v."""
    if not 0 < bits < 31:
        return v
    half, size = 1 << bits - 1, 1 << bits
    return (v + half).bitwiseAND(F.lit(size - 1)) - half


def difference(sample: Column, guess: Column, bits: int) -> Column:
    return wrap_difference(sample - guess, bits)


def reconstruct(guess: Column, diff: Column, bits: int) -> Column:
    return (guess + diff).bitwiseAND(F.lit((1 << bits) - 1))


def median_predict(left: Column, top: Column, top_left: Column) -> Column:
    return median3(left, top, left + top - top_left)


def as_signed16(v: Column) -> Column:
    return F.when(v >= 32768, v - 65536).otherwise(v)


def median_predict_signed16(left: Column, top: Column, top_left: Column) -> Column:
    return median_predict(as_signed16(left), as_signed16(top), as_signed16(top_left))


def _third_base(bits: int, extra: bool) -> bool:
    """With 9 to 15 bits and no extra plane, blue is the base of the transform; else green."""
    return 9 <= bits <= 15 and not extra


def forward_rct(r: Column, g: Column, b: Column, bits: int, extra: bool) -> tuple[Column, Column, Column]:
    """y (bits + 1 bits), and two differences moved up by 2**bits."""
    base, u, v = (b, g - b, r - b) if _third_base(bits, extra) else (g, b - g, r - g)
    y = (base + floor_shift(u + v, 2)).bitwiseAND(F.lit((2 << bits) - 1))
    return y, u + (1 << bits), v + (1 << bits)


def inverse_rct(y: Column, cb: Column, cr: Column, bits: int, extra: bool) -> tuple[Column, Column, Column]:
    u, v, mask = cb - (1 << bits), cr - (1 << bits), F.lit((1 << bits) - 1)
    base = y - floor_shift(u + v, 2)
    r, g, b = (v + base, u + base, base) if _third_base(bits, extra) else (v + base, base, u + base)
    return r.bitwiseAND(mask), g.bitwiseAND(mask), b.bitwiseAND(mask)


def gradients(n: dict[str, Column]) -> list[Column]:
    return [n["left"] - n["top_left"], n["top_left"] - n["top"], n["top"] - n["top_right"], n["far_left"] - n["left"], n["top_top"] - n["top"]]


def context_sum(n: dict[str, Column], tables: Sequence[Sequence[int]]) -> Column:
    """The quantised gradients' sum. Its size is the context number; below 0 the difference changes sign."""
    total = F.lit(0)
    for g, t in zip(gradients(n), tables, strict=True):
        if any(t):
            total = total + F.element_at(F.array(*map(F.lit, t)), g.bitwiseAND(F.lit(255)) + 1)
    return total


def fold(v: Column) -> Column:
    """0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unfold(n: Column) -> Column:
    return F.when(n % 2 == 0, F.shiftright(n, 1)).otherwise(-F.shiftright(n, 1) - 1)


def code_length(v: Column, k: int, bits: int) -> Column:
    """Bits of v in Golomb-Rice code with parameter k; 12 zeros announce an escaped value."""
    n = F.shiftright(fold(v), k)
    return F.when(n < 12, n + 1 + k).otherwise(F.lit(12 + bits))


def sign_extend(v: Column, bits: int) -> Column:
    return wrap_difference(v, bits)


def coded_plane_count(chroma: Column, extra: Column) -> Column:
    return 1 + 2 * chroma.cast("int") + extra.cast("int")


def subsampled(extent: Column, shift: Column) -> Column:
    """Ceiling of extent / 2**shift; shifts of 32 and more leave 1 of any extent."""
    size = F.pow(F.lit(2.0), F.least(shift, F.lit(40))).cast("long")
    return F.when(shift >= 32, (extent > 0).cast("long")).otherwise(F.floor((extent + size - 1) / size).cast("long"))


def grid_boundary(position: Column, extent: Column, cells: Column) -> Column:
    return F.floor(position.cast("long") * extent / cells).cast("long")


def slot_count(chroma: Column, extra: Column, version: Column) -> Column:
    return 1 + (chroma | (version <= 3)).cast("int") + extra.cast("int")


def plane_slot(plane: Column, chroma: Column, version: Column) -> Column:
    return F.when(plane == 0, 0).when(chroma & (plane <= 2), 1).when((version <= 3) | chroma, 2).otherwise(1)


def sample_bytes(bits: Column) -> Column:
    return F.when(bits <= 8, 1).otherwise(2)


def over_cif(width: Column, height: Column) -> Column:
    return width.cast("long") * height > 352 * 288
