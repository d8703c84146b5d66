"""Polygon covers and overlap-weighted resampling against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cinder.operators import geometry as geo

RINGS = "zone_id int, rings array<array<struct<x double, y double>>>"


def star(rng, cx, cy, n, least, most):
    a0 = rng.uniform(0, 6)
    ring = [(cx + r * math.cos(a0 + 2 * math.pi * i / n), cy + r * math.sin(a0 + 2 * math.pi * i / n))
            for i, r in enumerate(rng.uniform(least, most) for _ in range(n))]
    return [*ring, ring[0]]


def brute(x, y, rings):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay >= y) != (by >= y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


@pytest.mark.parametrize("cell", [1.0, 0.3])
def test_zones_equal_a_ray_cast_of_every_pair(spark, cell):
    rng = random.Random(5)
    zones = {i: [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.randint(3, 30), 0.5, rng.choice([2, 15])) for _ in range(rng.randint(1, 3))]
             for i in range(12)}
    zones[50] = [[(-30, -30), (30, -30), (30, 30), (-30, 30), (-30, -30)], [(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)]]   # with a hole
    zones[51] = [[(-3, 0), (3, 0), (3, 2), (0, 2), (0, 1), (-3, 1), (-3, 0)]]                                              # sides on cell sides
    points = [(i, rng.uniform(-32, 32), rng.uniform(-32, 32)) for i in range(1500)]
    points += [(2000 + i, float(rng.randint(-31, 31)), float(rng.randint(-31, 31))) for i in range(500)]                    # on cell corners
    points += [(3000 + i, rng.randint(-12, 12) / 2, rng.randint(-6, 6) / 2) for i in range(300)]
    pts = spark.createDataFrame(points, "k int, x double, y double")
    z = spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in zones.items()], RINGS)
    got = sorted((r.k, r.zone_id) for r in geo.polygon_zone(pts, "x", "y", z, cell).collect())
    assert got == sorted((k, i) for k, x, y in points for i, rings in zones.items() if brute(x, y, rings))


def test_cover_grows_with_the_border_not_the_area(spark):
    def size(side):
        ring = [(0.5, 0.5), (side, 0.5), (side, side), (0.5, side), (0.5, 0.5)]
        z = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ring]])], RINGS)
        return geo.polygon_cover(z, 1.0).count()
    small, large = size(100.5), size(800.5)
    assert large < 8 * small * 1.6 and large < 0.1 * 800 * 800


def test_points_and_zones_without_values(spark):
    z = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in [(0., 0.), (4., 0.), (4., 4.), (0., 4.), (0., 0.)]]]), (None, [[{"x": 0., "y": 0.}]]),
                               (2, None), (3, [])], RINGS)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 2.5, 2.5)], "k int, x double, y double")
    assert sorted(r.k for r in geo.polygon_zone(pts, "x", "y", z).collect()) == [1, 4]
    assert geo.polygon_zone(pts.limit(0), "x", "y", z).count() == 0 and geo.polygon_zone(pts, "x", "y", z.limit(0)).count() == 0


def test_overlap_weights_keep_sums(spark):
    rng = random.Random(2)
    fine_grid = {"x0": 0.0, "dx": 0.25, "y0": 10.0, "dy": -0.25, "width": 24, "height": 20}
    coarse = {"x0": -0.1, "dx": 0.7, "y0": 10.3, "dy": -0.55, "width": 12, "height": 12}
    cells = {(r, c): rng.random() for r in range(20) for c in range(24)}
    d = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "fine_row int, fine_col int, v double")
    got = {(r.grid_row, r.grid_col): r for r in geo.overlap_resample(d, fine_grid, coarse, "v").collect()}
    assert sum(r.weight for r in got.values()) == pytest.approx(480) and sum(r.covered for r in got.values()) == pytest.approx(480)
    assert sum(r.v * r.weight for r in got.values()) == pytest.approx(sum(cells.values()))
    for (R, C), row in got.items():
        top, left = 10.3 - 0.55 * R, -0.1 + 0.7 * C
        share = {}
        for (r, c), v in cells.items():
            h = min(top, 10 - 0.25 * r) - max(top - 0.55, 9.75 - 0.25 * r)
            w = min(left + 0.7, 0.25 * c + 0.25) - max(left, 0.25 * c)
            if h > 1e-12 and w > 1e-12:
                share[r, c] = h * w / 0.0625
        assert row.v == pytest.approx(sum(cells[k] * s for k, s in share.items()) / sum(share.values()))


def test_overlap_without_data_and_outside(spark):
    g = {"x0": 0.0, "dx": 1.0, "y0": 0.0, "dy": 1.0, "width": 2, "height": 1}
    d = spark.createDataFrame([(0, 0, None), (0, 1, 4.0), (0, 5, 9.0), (0, 1, float("nan"))], "fine_row int, fine_col int, v double")
    got = {(r.grid_row, r.grid_col): tuple(r)[2:] for r in geo.overlap_resample(d, {**g, "width": 9}, g, "v").collect()}
    assert got == {(0, 0): (None, 0.0, 1.0), (0, 1): (4.0, 1.0, 2.0)}
