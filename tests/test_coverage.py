"""The sweep over slices against cells that are counted one by one."""

import random
import time

import numpy as np

from lumaplan.operators.coverage import coverage, swept


def counted(rects):
    cells = {}
    for x, y, w, h in rects:
        for cx in range(x, x + w):
            for cy in range(y, y + h):
                cells[cx, cy] = cells.get((cx, cy), 0) + 1
    return len(cells), sum(n > 1 for n in cells.values())


def columns(rects):
    return tuple(np.array([r[i] for r in rects], np.int64) for i in range(4))


def test_sweep_is_the_count_of_cells():
    rng = random.Random(3)
    for n in range(200):
        rects = [(rng.randrange(9), rng.randrange(9), rng.randrange(0 if n % 3 else 1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(0, 12))]
        assert swept(*columns(rects)) == counted(rects), rects


def test_a_large_grid():
    """2,000 x 2,000 cells in stripes, columns and squares: the work follows the slices."""
    squares = [(x, y, 40, 40) for x in range(0, 2000, 40) for y in range(0, 2000, 40)]
    stripes = [(0, y, 2000, 1) for y in range(2000)]
    began = time.time()
    assert swept(*columns(squares)) == (4_000_000, 0) and swept(*columns(stripes)) == (4_000_000, 0)
    assert swept(*columns(squares[:-1])) == (4_000_000 - 1600, 0) and swept(*columns([*squares, (10, 10, 100, 5)])) == (4_000_000, 500)
    assert time.time() - began < 20


def test_verdicts(spark):
    streams = spark.createDataFrame([(1, 400, 300, 2000, 2000), (2, 10, 10, 2, 2)], "stream_id long, width long, height long, num_h long, num_v long")
    whole = [(x, y, 500, 500) for x in range(0, 2000, 500) for y in range(0, 2000, 500)]
    rows = [(1, 0, *r) for r in whole] + [(1, 1, *r) for r in whole[1:]] + [(1, 2, *r) for r in [*whole, (3, 3, 1, 1)]] + [(1, 3, 0, 0, 2000, 2000)] + [(2, 0, 0, 0, 2, 2), (2, 1, 0, 0, 0, 2)]
    got = coverage(spark.createDataFrame(rows, "stream_id long, frame_index long, raster_x long, raster_y long, raster_w long, raster_h long"), streams).collect()
    assert {(r["stream_id"], r["frame_index"]): (r["covered"], r["overlapping"], r["verdict"]) for r in got} == {
        (1, 0): (4_000_000, 0, "exact"), (1, 1): (3_750_000, 0, "open"), (1, 2): (4_000_000, 1, "overlap"), (1, 3): (4_000_000, 0, "too large"), (2, 0): (4, 0, "exact"), (2, 1): (0, 0, "open"),
    }
