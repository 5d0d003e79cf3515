"""Connected parts over many tiles against a walk over single pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motrac.operators import cells


def _walk(pixels, around):
    """{pixel: smallest number in its part}"""
    left, out = dict(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        part, todo = [start], [start]
        group = left.pop(start)
        while todo:
            f, x, y = todo.pop()
            for a, b in around:
                n = (f, x + a, y + b)
                if n in left and left[n] == group:
                    del left[n]
                    part.append(n)
                    todo.append(n)
        out |= {p: min(x * (1 << 20) + y for _, x, y in part) for p in part}
    return out


@pytest.mark.parametrize("tile", [4, 256])
@pytest.mark.parametrize("around", [cells.AROUND, [(1, 0), (-1, 0), (0, 1), (0, -1)]])
def test_parts_over_tiles(spark, monkeypatch, tile, around):
    monkeypatch.setattr(cells, "TILE", tile)
    rng = np.random.default_rng(tile)
    pixels = {(f, int(x), int(y)): int(rng.integers(1, 3)) for f in (0, 1) for x, y in rng.integers(-9, 15, (420, 2))}
    spiral = {(2, x, y): 1 for x in range(14) for y in range(14) if (x % 4 == 0) or (y == 13 and x % 8 < 4) or (y == 0 and x % 8 > 4)}
    pixels |= spiral
    rows = [(*p, g) for p, g in pixels.items()]
    px = spark.createDataFrame(rows + rows[:5] + [(0, 40, 40, None), (0, None, 3, 1)], "frame int, x int, y int, label int")
    parts = cells.components(px, F.col("label"), around).collect()
    assert sorted((r["frame"], r["x"], r["y"], r["group"], r["part"]) for r in parts) == sorted((*p, pixels[p], n) for p, n in _walk(pixels, around).items())


def test_parts_are_not_broadcast(spark):
    """A stored table of parts is far smaller than its rows in memory; no join may send it to the driver."""
    px = spark.range(60000).select(F.lit(0).alias("frame"), (F.col("id") % 300).cast("int").alias("x"), F.floor(F.col("id") / 300).cast("int").alias("y"))
    for df in (cells.components(px, F.lit(1)), cells.bunches(px, F.lit(True), 1)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
