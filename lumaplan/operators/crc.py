"""The bitstream's CRC as an ordinary aggregate of chunks that may come in any order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaplan.operators.bits import POLYNOMIAL, crc32_msb

_FULL = 0xFFFFFFFF


def times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo the CRC's; bit i stands for x**i."""
    out = 0
    for i in range(31, -1, -1):
        out = (out << 1 ^ (POLYNOMIAL if out >> 31 else 0)) & _FULL
        out ^= a if b >> i & 1 else 0
    return out


@lru_cache(maxsize=2)
def byte_powers(back: bool) -> tuple[int, ...]:
    """x**(8 * 2**k) for k = 0, 1 ... 39, or of the inverse of x, which is there as the polynomial ends in one."""
    p = (POLYNOMIAL >> 1) | 1 << 31 if back else 2
    for _ in range(3):
        p = times(p, p)
    out = []
    for _ in range(40):
        out.append(p)
        p = times(p, p)
    return tuple(out)


def _times(a: Column, b: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        shifted = F.shiftleft(acc, 1).bitwiseXOR(F.when(F.shiftright(acc, 31) == 1, F.lit(POLYNOMIAL | 1 << 32)).otherwise(F.lit(0).cast("long")))
        return shifted.bitwiseXOR(a * F.call_function("shiftright", b, i).bitwiseAND(F.lit(1).cast("long")))

    return F.aggregate(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step)


def crc_moved(crc: Column, n: Column, back: bool = False) -> Column:
    """The CRC after n more zero bytes (back: what it was n zero bytes ago)."""
    powers = F.array(*(F.lit(p).cast("long") for p in byte_powers(back)))
    bit = lambda k: F.call_function("shiftright", n.cast("long"), k).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.aggregate(F.sequence(F.lit(0), F.lit(39)), crc.cast("long"), lambda acc, k: F.when(bit(k), _times(acc, F.get(powers, k))).otherwise(acc))


def chunk_crc(data: Column) -> Column:
    """The CRC of each chunk by itself; null: 0."""

    @F.arrow_udf("long")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunks in batches:
            yield pa.array([crc32_msb(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in chunks], pa.int64())

    return crc(data)


def combined_crc(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, n_bytes, crc of the bytes whose chunks (offset, data) each group has; chunks are whole and don't overlap, in any order.

    A CRC without complements is linear: the whole's is the sum (exclusive or) of the chunks', each moved over the bytes behind
    it. As those are the total less the chunk's end, each chunk is moved back over its own end, and the sum forward over the
    total: a plain aggregate with partial sums, one row a key and task in the shuffle, and no chunk waits for another.
    """
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    moved = chunks.select(*keys, size.alias("size"), crc_moved(chunk_crc(F.col("data")), F.col("offset") + size, back=True).alias("part"))
    sums = moved.groupBy(*keys).agg(F.sum("size").alias("n_bytes"), F.bit_xor("part").alias("part"))
    return sums.select(*keys, "n_bytes", crc_moved(F.col("part"), F.col("n_bytes")).alias("crc"))
