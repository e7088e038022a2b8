"""Scaled radii by bands, and coverage by nested equal-area cells, against brute force."""

import math
import random

from pyspark.sql import functions as F

from skyloom.operators import coverage, crossmatch


def apart(a, b):
    (ra1, d1), (ra2, d2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h)))) * 3600


def crowd(rng, n, at, width):
    return [((at[0] + rng.gauss(0, width) / max(math.cos(math.radians(at[1])), 0.02)) % 360, max(-90.0, min(90.0, at[1] + rng.gauss(0, width)))) for _ in range(n)]


def test_bands_of_radii_on_clusters(spark):
    rng = random.Random(4)
    places = [(0.01, 3.0), (200.0, -89.95), (100.0, 40.0)]
    left = [(i, *p) for i, p in enumerate(q for at in places for q in crowd(rng, 250, at, 0.05))]
    right = [(i, *p, rng.choice([0.001, 0.02, 0.05, 0.2, 1.5, None, float("nan")])) for i, p in enumerate(q for at in places for q in crowd(rng, 250, at, 0.05))]
    a = spark.createDataFrame(left, "objectId long, ra double, dec double")
    b = spark.createDataFrame(right, "other long, ra double, dec double, z double")
    own = lambda z: 0 if z is None or z != z else 300.0 if z < 0.01 else 100.0 * 0.05 / z
    want = {(i, j) for i, *p in left for j, *q, z in right if (d := apart(p, q)) < own(z) and d <= 240.0}
    for split in (None, 20):
        how = crossmatch.Catalog("b", 240.0, ("other", "z"), "z", 100.0, 300.0, crowded=split)
        got = crossmatch.matches(a, b, how).select("objectId", "match.row.other").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert crossmatch.matches(a, b.where("false"), how).count() == 0


def naive_pixel(ra, dec, depth):
    """The nested number by going down the tree: which child's face coordinates hold the point."""
    z, n = math.sin(math.radians(dec)), 1 << depth
    t = (ra % 360) / 90
    if abs(z) <= 2 / 3:
        up, down = n * (0.5 + t - 0.75 * z), n * (0.5 + t + 0.75 * z)
        p, m = math.floor(up), math.floor(down)
        fp, fm = p // n, m // n
        face = fp % 4 + 4 if fp == fm else fp % 4 if fp < fm else fm % 4 + 8
        x, y = m % n, n - 1 - p % n
    else:
        k = min(3, int(t))
        s = n * math.sqrt(6) * math.sin(math.radians(90 - abs(dec)) / 2)
        p, m = min(n - 1, int((t - k) * s)), min(n - 1, int((1 - t + k) * s))
        face, x, y = (k, n - 1 - m, n - 1 - p) if z > 0 else (k + 8, p, m)
    return face * n * n + sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(depth))


def test_cells_nest_and_have_equal_areas(spark):
    rng = random.Random(5)
    points = [(0.0, 0.0), (359.9999, 0.0), (0.0, 90.0), (123.0, -90.0), (45.0, 41.8), (90.0, -41.9), (-10.0, 20.0), (370.0, 20.0)] + [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(20000)]
    df = spark.createDataFrame(points, "ra double, dec double")
    cells = df.select("ra", "dec", *(coverage.pixel(F.col("ra"), F.col("dec"), k).alias(f"p{k}") for k in (0, 1, 3, 11, 20))).collect()
    for r in cells:
        assert (r.p0, r.p1, r.p3, r.p11) == tuple(naive_pixel(r.ra, r.dec, k) for k in (0, 1, 3, 11))
        assert r.p0 == r.p1 >> 2 == r.p3 >> 6 == r.p11 >> 22 == r.p20 >> 40
    counts = [0] * 48
    for r in cells:
        counts[r.p1] += 1
    assert min(counts) > 330 and max(counts) < 510
    assert coverage.pixel(F.lit(1.0), F.lit(None).cast("double"), 5) is not None


def test_coverage_of_overlapping_cells(spark):
    rng = random.Random(6)
    cells = [(k, rng.randrange(12 * 4**k)) for k in (0, 2, 3, 5, 5, 5, 7, 7, 11) for _ in range(4 if k else 1)] + [(5, 100), (6, 401), (5, 101), (None, 3), (2, None)]
    ranges = coverage.ranges(spark.createDataFrame(cells, "depth int, cell long"), 11)
    got = sorted(map(tuple, ranges.collect()))
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and len(got) < len(cells) - 3  # disjoint, and those that touch are one
    points = [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(3000)] + [(9000, None, 1.0), (9001, 1.0, float("nan"))]
    marked = coverage.covered(spark.createDataFrame(points, "id long, ra double, dec double"), ranges, 11)
    inside = {(i, any(naive_pixel(ra, dec, 11) >> 2 * (11 - k) == c for k, c in cells if k is not None and c is not None) if i < 9000 else False) for i, ra, dec in points}
    assert {(r.id, r.covered) for r in marked.collect()} == inside and 200 < sum(x for _, x in inside) < 2800
