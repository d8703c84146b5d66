"""Hand-made edge cases (FIXTURES section 3) on a few rows each."""

import math

import pytest
from pyspark.sql import functions as F


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_nan_skipped_in_annual_max_and_mean(spark):
    from cinder.operators.coarse import annual_composite
    nan = float("nan")
    df = spark.createDataFrame(
        [(0, 0, 2004, 1, nan, 1.0, 0.0, 0.0), (0, 0, 2004, 2, 0.3, nan, 0.0, 0.0),
         (1, 1, 2004, 1, nan, nan, 0.0, 0.0)],
        "grid_row int, grid_col int, year int, month int, fraction double, DEM double, longitude double, latitude double")
    out = annual_composite(df, features=["DEM"]).orderBy("grid_row").collect()
    assert out[0]["fraction"] == 0.3 and out[0]["DEM"] == 1.0
    assert out[1]["fraction"] is None and out[1]["DEM"] is None   # all months NaN -> NULL


def test_mode_tie_takes_lowest_code(spark):
    from cinder.operators.coarse import coarse_grid
    df = spark.createDataFrame([(2004, 0.5, 0.5, 0.2, 7.0), (2004, 0.6, 0.6, 0.2, 3.0)],
                               "year int, longitude double, latitude double, fraction double, b1 double")
    out = coarse_grid(df, 1.0, features=["b1"]).first()
    assert out["b1"] == 3.0


def test_fraction_bin_gaps_and_ternary_label(spark):
    from cinder.functions.labels import fraction_bin, ternary_label
    df = spark.createDataFrame([(0.005,), (0.335,), (0.665,), (0.0,), (0.5,), (1.0,)], "f double")
    got = rows(df.select("f", fraction_bin("f").alias("b"), ternary_label("f").alias("t")), "f", "b", "t")
    assert got == [(0.005, None, 0), (0.335, None, 0), (0.665, None, 1), (0.0, 0, 0), (0.5, 2, None),
                   (1.0, 3, 1)]


def test_negative_longitude_floors_down(spark):
    from cinder.operators.geometry import snap
    df = spark.createDataFrame([(-0.5,), (-170.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(snap("x", 1.0)).collect()] == [-1.0, -170.0, 0.0]


def test_leap_year_doy_ranges(spark):
    from cinder.functions.dates import doy_range
    df = spark.createDataFrame([(2004, 2), (2004, 3), (2003, 3)], "y int, m int")
    a, b = doy_range("y", "m")
    assert rows(df.select(a.alias("a"), b.alias("b")), "a", "b") == [(32, 60), (61, 91), (60, 90)]


def test_zone_without_burn_gets_zero(spark):
    from cinder.operators.zonal import zonal_burned_area
    mask = spark.createDataFrame([(0, 0, 2004, 1), (0, 1, 2004, 0)], "grid_row int, grid_col int, year int, burned int")
    pix = spark.createDataFrame([(0, 0, 1, 1e10), (0, 1, 2, 1e10)],
                                "grid_row int, grid_col int, zone_id int, area_m2 double")
    zones = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "zone_id int, ecoregion string")
    got = sorted(rows(zonal_burned_area(mask, pix, zones), "ecoregion", "burned_mha"))
    assert got == [("A", 1.0), ("B", 0.0), ("C", 0.0)]


def test_point_on_edge_left_top_inclusive(spark):
    from cinder.operators.geometry import point_in_ring
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                     for x, y in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]])
    pts = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (0.5, 1.0), (0.5, 0.0), (0.5, 0.5)], "x double, y double")
    got = [r[0] for r in pts.select(point_in_ring(F.col("x"), F.col("y"), ring)).collect()]
    assert got == [True, False, True, False, True]   # left in, right out, top in, bottom out


def test_zones_with_holes_and_parts(spark):
    from cinder.operators.geometry import polygon_zone
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    zones = spark.createDataFrame([
        (1, [square(0.0, 0.0, 4.0, 4.0), square(1.0, 1.0, 3.0, 3.0)]),      # a hole
        (2, [square(1.5, 1.5, 2.5, 2.5), square(10.0, 0.0, 11.0, 1.0)]),    # in the hole, and a far part
        (3, []), (4, None)], "zone_id int, rings array<array<struct<x double, y double>>>")
    pts = spark.createDataFrame([("edge", 0.5, 0.5), ("hole", 1.2, 1.2), ("island", 2.0, 2.0), ("far", 10.5, 0.5),
                                 ("between", 6.0, 0.5), ("none", None, 0.5)], "name string, x double, y double")
    got = {r["name"]: r["zone_id"] for r in polygon_zone(pts, "x", "y", zones).collect()}
    assert got == {"edge": 1, "island": 2, "far": 2}


def test_duplicate_prediction_ids_raise(spark):
    from cinder.operators.joins import CardinalityError, join_predictions
    cells = spark.createDataFrame([(1,), (2,)], "ID long")
    preds = spark.createDataFrame([(1, 0.2), (1, 0.3)], "ID long, p double")
    with pytest.raises(CardinalityError):
        join_predictions(cells, preds, ["ID"])


def test_zero_predicted_positives_give_zero_metrics(spark):
    from cinder.operators.metrics import metrics_at_thresholds
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double")
    r = metrics_at_thresholds(df, "y", "p", [0.5]).first()
    assert (r["precision"], r["recall"], r["f1"], r["iou"]) == (0.0, 0.0, 0.0, 0.0)


def test_area_match_without_burn_is_099(spark):
    from cinder.operators.metrics import area_match_threshold
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "y int, p double")
    assert area_match_threshold(df, "y", "p").first()["threshold"] == 0.99


def test_prob_rescale_fixed_points(spark):
    from cinder.operators.masks import prob_rescale
    df = spark.createDataFrame([(0.0,), (0.99,), (1.0,)], "p double")
    got = [round(r[0], 12) for r in df.select(prob_rescale("p")).collect()]
    assert got == [0.0, 0.5, 1.0]


def test_band_name_sanitising(spark):
    from cinder.functions.names import sanitize_names
    df = spark.createDataFrame([(1, "B 1"), (2, "B_1"), (3, None), (4, "")], "pos int, name string")
    out = sanitize_names(df.withColumn("g", F.lit(1)), "name", ["g"], "pos").orderBy("pos")
    assert [r["safe_name"] for r in out.collect()] == ["B_1", "B_1_2", "band", "band_2"]


def test_missing_month_rows_and_monthless_sources_skipped(spark):
    from cinder.operators.joins import join_sources
    a = spark.createDataFrame([(1.0, 2004, 1, 5.0), (1.0, 2004, None, 6.0), (1.0, 2004, 0, 7.0)],
                              "x double, year int, month int, A__v double")
    b = spark.createDataFrame([(1.0, 2004, 9.0)], "x double, year int, B__v double")
    out = join_sources([a, b], ["x", "year", "month"]).collect()
    assert len(out) == 1 and out[0]["A__v"] == 5.0 and "B__v" not in out[0].asDict()


SCORES = "grid_row int, grid_col int, year int, month int, fraction double, p double"


def _land(spark, folder, rows):
    spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(folder)


def test_annual_mask_stream_takes_months_in_any_order(spark, tmp_path):
    from cinder.plans.stream_q import MONTH_SCHEMA
    from cinder.streaming.incremental import incremental_annual_mask
    landing, target, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([(0, 0, 2001, 1, 0.0, 0.2), (9, 9, 2001, 1, 0.0, None)], [(0, 0, 1995, 7, 0.0, 0.9)],
                 [(0, 0, 2001, 12, 0.0, 0.7), (5, 5, 1995, 7, 0.0, 0.1)], [(0, 0, 2001, 3, 0.0, 0.6)]):
        _land(spark, landing, rows)
        incremental_annual_mask(spark, landing, target, ck, MONTH_SCHEMA)
    got = {(r.grid_row, r.year): (r.annual_max, r.burned) for r in spark.read.parquet(target).collect()}
    assert got == {(0, 2001): (0.7, 1), (9, 2001): (None, None), (0, 1995): (0.9, 1), (5, 1995): (0.1, 0)}


def test_ingest_stream_merges_files_of_a_month(spark, tmp_path):
    import time

    from cinder.plans.stream_q import MONTH_SCHEMA
    from cinder.streaming.incremental import incremental_ingest
    landing, target, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([(0, 0, 2001, 1, 0.1, 0.2)], [(5, 5, 2001, 1, 0.3, 0.4)], [(0, 0, 2001, 1, 0.9, 0.2), (1, 1, 1995, 2, 0.5, 0.5)]):
        _land(spark, landing, rows)
        time.sleep(1.1)                     # file times are what tells newer rows
        incremental_ingest(spark, landing, target, ck, MONTH_SCHEMA)
    got = {(r.grid_row, r.year): r.fraction for r in spark.read.parquet(target).collect()}
    assert got == {(0, 2001): 0.9, (5, 2001): 0.3, (1, 1995): 0.5}


def test_bilinear_ignores_null_neighbours_and_keeps_lonely_points(spark):
    from cinder.operators.geometry import bilinear_resample
    grid = {"x0": 0.0, "dx": 1.0, "y0": 0.0, "dy": 1.0}
    source = spark.createDataFrame([(0, 0, 10.0), (0, 1, None), (1, 0, 10.0), (1, 1, 10.0)], "grid_row int, grid_col int, v double")
    target = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0)], "id int, x double, y double")
    got = {r.id: r.v for r in bilinear_resample(target, source, grid, "v").collect()}
    assert got == {1: 10.0, 2: None}


def test_equal_area_projection_on_the_ellipsoid(spark):
    """The square of the radius is the area of the cap over pi, here summed along the meridian."""
    import math

    from cinder.operators.geometry import WGS84_A, WGS84_F, lonlat_from_xy, project_lonlat
    e2 = 2 * WGS84_F - WGS84_F**2

    def cap(lat, n=20_000):
        lo, hi = math.radians(lat), math.pi / 2
        total = 0.0
        for i in range(n):
            phi = lo + (hi - lo) * (i + 0.5) / n
            w = 1 - e2 * math.sin(phi) ** 2
            total += WGS84_A**2 * (1 - e2) * math.cos(phi) / w**2
        return 2 * total * (hi - lo) / n

    lats = [45.0, 60.0, 70.0, 89.9]
    df = project_lonlat(spark.createDataFrame([(33.0, lat) for lat in lats], "lon0 double, lat0 double"), "lon0", "lat0", "EPSG:6931")
    for r in df.collect():
        assert abs(math.hypot(r.proj_x, r.proj_y) - math.sqrt(cap(r.lat0))) < 0.01
    points = spark.createDataFrame([(lon, lat) for lon in (-180.0, -45.1, 0.0, 77.7, 179.9) for lat in (31.0, 60.0, 75.5, 89.0)], "lon0 double, lat0 double")
    for crs in ("EPSG:3413", "EPSG:6931"):
        back = lonlat_from_xy(project_lonlat(points, "lon0", "lat0", crs), "proj_x", "proj_y", crs)
        assert all(abs(r.lon - r.lon0) < 1e-6 and abs(r.lat - r.lat0) < 1e-6 for r in back.collect())


def test_focal_terms_are_derivatives_of_the_loss(spark):
    from pyspark.sql import functions as F

    from cinder.operators.metrics import focal_terms
    h = 1e-4
    rows = [(z / 2, y) for z in range(-9, 10) for y in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "z double, y double")
    at = {d: focal_terms(F.col("z") + d * h, F.col("y")) for d in (-1, 0, 1)}
    for r in df.select(at[0]["grad"].alias("g"), at[0]["hess"].alias("hh"), at[0]["loss"].alias("l"),
                       at[1]["loss"].alias("up"), at[-1]["loss"].alias("down")).collect():
        assert abs(r.g - (r.up - r.down) / (2 * h)) < 1e-5 and abs(r.hh - (r.up - 2 * r.l + r.down) / h**2) < 1e-4


def test_class_balance_reports_missing_labels(spark):
    from cinder.operators.diagnostics import class_balance
    r = class_balance(spark.createDataFrame([(1,), (0,), (None,)], "label int")).first()
    assert (r.n_total, r.n_pos, r.n_neg, r.n_null, r.pct_pos) == (3, 1, 1, 1, 50.0)


def test_checkpoint_dir_comes_from_session(spark):
    from cinder.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
