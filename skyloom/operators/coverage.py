"""Sky coverage in nested cells of equal area (the published HEALPix partition, nested numbering).

A position's cell is column arithmetic, so it needs no table and no Python worker. A coverage map, cells of several
depths, becomes disjoint ranges of the numbers at one depth; positions meet them by a range join on coarser cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import sky

#: Depth of the cells that ranges and positions meet in: 12 * 4 ** COARSE of them.
COARSE = 5


def _spread(x: Column) -> Column:
    """The bits of a number at every other place: its binary digits, read to base four."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def pixel(ra: Column, dec: Column, depth: int) -> Column:
    """The nested number of the cell that holds a position, at a depth of up to 29; null without finite coordinates."""
    n = 1 << depth
    ra, dec = sky.number(ra), sky.number(dec)
    z, t = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    whole = lambda x: F.floor(x).cast("long")
    # between the polar caps the cells' borders are straight lines in (t, z)
    p, m = whole(n * (0.5 + t - 0.75 * z)), whole(n * (0.5 + t + 0.75 * z))
    fp, fm = F.shiftright(p, depth), F.shiftright(m, depth)
    belt = F.when(fp == fm, fp % 4 + 4).when(fp < fm, fp % 4).otherwise(fm % 4 + 8)
    side = F.lit(n - 1).cast("long")
    # in a cap they run along the distance from the pole
    k = F.least(whole(t), F.lit(3).cast("long"))
    s = n * (6**0.5) * F.sin(F.radians(90.0 - F.abs(dec)) / 2)
    q, r = F.least(whole((t - k) * s), side), F.least(whole((1 - t + k) * s), side)
    north = z > 0
    inner = F.abs(z) <= 2 / 3
    face = F.when(inner, belt).when(north, k).otherwise(k + 8)
    x = F.when(inner, m.bitwiseAND(side)).when(north, side - r).otherwise(q)
    y = F.when(inner, side - p.bitwiseAND(side)).when(north, side - q).otherwise(r)
    return face * (n * n) + _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def ranges(cells: DataFrame, depth: int) -> DataFrame:
    """(low, high): disjoint ranges of numbers at a depth, the end not included, from cells (depth, cell) that may overlap.

    Cells finer than the depth count whole. The map is cut by its coarsest cells, twelve of them, and each part is put in
    order on its own; ranges that touch inside a part are one.
    """
    known = cells.where("depth IS NOT NULL AND cell IS NOT NULL")
    shift = F.lit(2) * (F.lit(depth) - F.col("depth"))
    at = lambda c: F.expr(f"CASE WHEN depth <= {depth} THEN shiftleft({c}, 2 * ({depth} - depth)) ELSE shiftright({c}, 2 * (depth - {depth})) END")
    low = at("cell")
    spans = known.select(low.alias("low"), F.when(shift >= 0, at("cell + 1")).otherwise(low + 1).alias("high")).withColumn("face", F.shiftright("low", 2 * depth))
    w = Window.partitionBy("face").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("new", F.coalesce((F.col("low") > before), F.lit(True)).cast("int"))
    numbered = first.withColumn("part", F.sum("new").over(w))
    parts = numbered.groupBy("face", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return parts.select("low", "high")


def covered(df: DataFrame, ranges: DataFrame, depth: int, ra: str = "ra", dec: str = "dec", name: str = "covered") -> DataFrame:
    """The rows with a flag: whether their position lies in one of the disjoint ranges. Without a position it doesn't."""
    down = 2 * max(depth - COARSE, 0)
    whole = ranges.select(F.col("low").alias("__low"), F.col("high").alias("__high"), F.explode(F.sequence(F.shiftright("low", down), F.shiftright(F.col("high") - 1, down))).alias("__coarse"))
    at = df.withColumn("__cell", pixel(F.col(ra), F.col(dec), depth)).withColumn("__over", F.shiftright("__cell", down))
    met = at.join(whole, (F.col("__over") == F.col("__coarse")) & (F.col("__cell") >= F.col("__low")) & (F.col("__cell") < F.col("__high")), "left")
    return met.withColumn(name, F.col("__low").isNotNull()).drop("__cell", "__over", "__low", "__high", "__coarse")


# ---- cones as ranges ----


def place(face: int, u: float, v: float) -> tuple[float, float]:
    """(ra, dec) of a point of one of the twelve coarsest cells, (0, 0) its southern and (1, 1) its northern corner.

    In the plane a cell is a square on its corner; towards a pole the plane's triangles close up.
    """
    k, row = face % 4, face // 4
    m, p = k + (row == 0) + u, k + (row == 2) + 1 - v
    t, h = (m + p - 1) / 2, (m - p) / 2
    if abs(h) <= 0.5:
        return t * 90 % 360, math.degrees(math.asin(max(-1.0, min(1.0, h * 4 / 3))))
    s = 2 * (1 - abs(h))
    z = math.copysign(1 - s * s / 3, h)
    if s > 0:
        t = k + 0.5 + (t - k - 0.5) / s
    return t * 90 % 360, math.degrees(math.asin(max(-1.0, min(1.0, z))))


def _apart(a: tuple[float, float], b: tuple[float, float]) -> float:
    (a1, d1), (a2, d2) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((a2 - a1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def cone(ra: float, dec: float, degrees: float, depth: int) -> list[tuple[int, int]]:
    """Ranges (low, high), the end not included, of the numbers at a depth that hold every position within a cone.

    Cells are halved while they may meet the cone and are wider than half its radius, so there are some tens of ranges
    whatever the depth. Ranges may hold positions outside; none inside is left out.
    """
    found, wanted = [], [(f, 0, 0, 0, 0) for f in range(12)]
    while wanted:
        face, level, x, y, number = wanted.pop()
        n = 1 << level
        centre = place(face, (x + 0.5) / n, (y + 0.5) / n)
        # edges bulge a little beyond the circle through a cell's corners
        reach = 1.2 * max(_apart(centre, place(face, (x + i) / n, (y + j) / n)) for i in (0, 1) for j in (0, 1)) + 1e-9
        far = _apart((ra, dec), centre)
        if far > degrees + reach:
            continue
        if level == depth or far + reach <= degrees or reach <= degrees / 2:
            down = 2 * (depth - level)
            low = ((face << (2 * level)) | number) << down
            found.append((low, low + (1 << down)))
        else:
            wanted += [(face, level + 1, 2 * x + i, 2 * y + j, number << 2 | j << 1 | i) for i in (0, 1) for j in (0, 1)]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and merged[-1][1] == low:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    return merged
