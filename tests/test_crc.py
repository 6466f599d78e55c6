"""CRCs of chunks put together."""

import random

from pyspark.sql import functions as F

from lumaplan.operators.bits import crc32_msb
from lumaplan.operators.crc import byte_powers, combined_crc, crc_moved, times


def test_powers():
    assert times(2, (0x04C11DB7 >> 1) | 1 << 31) == 1
    assert all(times(a, b) == 1 for a, b in zip(byte_powers(False), byte_powers(True), strict=True))
    data = b"some bytes"
    assert times(crc32_msb(data), byte_powers(False)[3]) == crc32_msb(data + bytes(8))


def test_chunks_in_any_order(spark):
    rng, rows, want = random.Random(4), [], {}
    for key in range(12):
        data = rng.randbytes(rng.randrange(0, 3000))
        want[key] = (len(data), crc32_msb(data))
        at = 0
        while at < len(data) or at == 0:
            n = rng.choice([1, 2, 7, 64, 1000])
            rows.append((key, at, bytearray(data[at : at + n]) if data else None, "clash"))
            at += n
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "key long, offset long, data binary, crc string").repartition(5)
    assert {r["key"]: (r["n_bytes"], r["crc"]) for r in combined_crc(chunks, "key").collect()} == want
    assert combined_crc(chunks.limit(0), "key").count() == 0
    far = spark.range(1).select(crc_moved(crc_moved(F.lit(123456789), F.lit(10**12)), F.lit(10**12), back=True).alias("c"))
    assert far.first()["c"] == 123456789
