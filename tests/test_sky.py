import math
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import reducers, wcs
from nightloom.functions.projection import Projection, find_bounds
from nightloom.jobs.queries import ORACLE_SQL, QUERIES
from nightloom.operators import frames, geometry, sky, stack, stars
from nightloom.sources import catalog, fits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, (float, Decimal)) else v
    rows = lambda data: sorted(str([clean(v) for v in r]) for r in data)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    want = rows(found.fetchall())
    assert want and rows(map(tuple, df.select(*columns).collect())) == want


def test_reducers_on_fixed_stacks():
    plain = np.array([9999.0] + [1.0] * 32 + [4.0] * 55 + [7.0] * 32)
    tall = np.array([9999.0] + [1.0] * 20 + [4.0] * 55 + [7.0] * 20)
    assert reducers.gaussian_centre(plain) == pytest.approx(4, rel=1e-7)
    assert math.isnan(reducers.gaussian_centre(plain[:10]))
    assert reducers.gaussian_centre(tall, amplitude=True) == pytest.approx(4, rel=1e-7)
    assert math.isnan(reducers.gaussian_centre(tall[:10], amplitude=True))
    assert reducers.gaussian_centre(np.arange(200.0), amplitude=True) == -math.inf


def test_skew_location_of_a_skewed_sample():
    rng = np.random.default_rng(0)
    u, w = np.abs(rng.normal(size=20000)), rng.normal(size=20000)
    assert reducers.skew_location(1 + 2 * (0.95 * u + math.sqrt(1 - 0.95**2) * w)) == pytest.approx(1, abs=0.15)


def test_percentiles_of_a_ramp(spark):
    ramp = spark.range(101).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"), F.lit(0).alias("y"), F.col("id").cast("double").alias("v"))
    found = stack.percentile_map(ramp, [10, 15]).collect()
    assert len(found) == 10 and {(r.output_idx, r.value) for r in found} == {(0, 10.0), (1, 15.0)}


def test_clip_by_rounds_equals_the_kernel(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in range(3) for v in rng.standard_t(2, 400)] + [(9, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    found = {r.k: r.value for r in stack.clip_by_rounds(df, "k", 2.0, 10).collect()}
    for k in range(3):
        assert found[k] == pytest.approx(reducers.clipped_mean(np.array([v for j, v in rows if j == k]), 2.0, 10))


@pytest.mark.parametrize("grid", [wcs.default_grid(1.0), wcs.CarGrid((180.5, 25.5), (90.0, 30.0), (1.0, 1.0), (50, 360))])
def test_wcs_round_trip(spark, grid):
    sky = spark.range(1, 200).select((F.col("id") * 1.7 % 360).alias("ra"), (F.col("id") * 0.83 % 160 - 80).alias("dec"))
    x, y = wcs.world_to_pixel(F.col("ra"), F.col("dec"), grid)
    ra, dec = wcs.pixel_to_world(x, y, grid)
    worst = sky.select(F.max(F.abs(F.pmod(ra - F.col("ra") + 180, F.lit(360.0)) - 180)).alias("a"), F.max(F.abs(dec - F.col("dec"))).alias("d")).first()
    assert worst.a < 1e-9 and worst.d < 1e-9


def test_cropping_moves_the_reference_pixel():
    grid = wcs.default_grid(0.2).cropped(745, 354, (215, 195))
    assert (round(grid.crpix[0], 6), round(grid.crpix[1], 6)) == (155.5, 96.5)


def test_zpn_inverse():
    theta = np.array([89.0, 70.0, 40.0])
    z = np.deg2rad(90 - theta)
    assert wcs.zpn_theta(np.rad2deg(z + 0.01 * z**3), np.array([0, 1, 0, 0.01])) == pytest.approx(theta)


def test_straddling_frame_gives_two_boxes(spark):
    frame = spark.createDataFrame([(1, "c", 0.5, 10.0, 2.0), (2, "c", 100.0, 10.0, 2.0)], "image_id int, camera string, ra0 double, dec0 double, half double")
    boxes = geometry.bounds(geometry.edge_points(frame, 50), wcs.default_grid(1.0)).groupBy("image_id").count().collect()
    assert {(r.image_id, r["count"]) for r in boxes} == {(1, 2), (2, 1)}


def test_catalogue_lines(spark):
    lines = [("1; 2 30 00; +10 30 00; 2",), ("2; 2 30 30; +10 30 30; 5",), ("3; 12 30 30; -10 30 30; 10",), ("4; 8 00 00; -01 00 00; 10",), ("5; 1 1 1; -00 30 00; ~",), ("broken",)]
    found = {r.star_id: (r.ra, r.dec, r.vmag) for r in catalog.parse(spark.createDataFrame(lines, "value string")).collect()}
    assert found["1"] == (37.5, 10.5, 2.0) and found["3"] == pytest.approx((187.625, -10.508333333, 10.0)) and found["4"] == (120.0, -1.0, 10.0) and set(found) == set("1234")


def test_catalogue_file_drops_header_and_last_line(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join([f"header {k}" for k in range(43)] + ["1; 2 30 00; +10 30 00; 2", "2; 2 30 30; +10 30 30; 5", "; end; of; file"]) + "\n")
    assert {r.star_id for r in catalog.read(spark, str(tmp_path / "c.txt")).collect()} == {"1", "2"}


def _stamp(image, cy, cx, width, amplitude):
    for dy in range(-6, 7):
        for dx in range(-6, 7):
            image[cy + dy, cx + dx] += amplitude * math.exp(-(dx * dx + dy * dy) / width**2)


def test_aperture_flux_of_gaussian_stars(spark):
    image = np.full((50, 50), 20.0)
    places = [(15, 22, 2, 1), (30, 36, 2, 1), (32, 18, 3, 2)]
    for star in places:
        _stamp(image, *star)
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(50) for x in range(50)], "image_id int, y int, x int, v double")
    at = spark.createDataFrame([(0, k, float(x), float(y)) for k, (y, x, _, _) in enumerate(places)] + [(0, 9, 1.0, 1.0)], "image_id int, star_id int, x double, y double")
    found = {r.star_id: r.flux for r in stars.aperture_flux(pixels, at, (50, 50), 7, 2, 3).collect()}
    assert set(found) == {0, 1, 2}
    for k, (_, _, width, amplitude) in enumerate(places):
        assert found[k] == pytest.approx(amplitude * math.pi * width**2, rel=2e-2)


def test_missing_pixel_spreads_over_the_kernel(spark):
    pixels = spark.createDataFrame([(0, y, x, None if (y, x) == (4, 4) else 1.0) for y in range(9) for x in range(9)], "image_id int, y int, x int, v double")
    found = {(r.y, r.x): r.v for r in frames.convolve(pixels, frames.blur_kernel(), (9, 9)).collect()}
    assert found[2, 2] is None and found[6, 6] is None and found[7, 7] is not None


def test_fits_reader_finds_the_sky_axes(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "CTYPE1  = 'HPLN-ZPN'", "CTYPE2  = 'HPLT-ZPN'", "CTYPE1A = 'RA---ZPN'", "CTYPE2A = 'DEC--ZPN'", "END"]
    raw = "".join(c.ljust(80) for c in cards).ljust(2880).encode() + np.arange(6, dtype=">f4").tobytes().ljust(2880, b"\0")
    (tmp_path / "a.fits").write_bytes(raw)
    row = fits.read(spark, str(tmp_path / "a.fits")).first()
    assert (row.ny, row.nx, row.wcs_key, row.data) == (2, 3, "A", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]) and row.meta["CTYPE1A"] == "RA---ZPN"


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_adaptive_resampling():
    from nightloom.functions import resample as R

    rng = np.random.default_rng(0)
    image = rng.normal(size=(20, 20)) + 5
    taps = frames.shift_weights(0.0, 0.0)
    same = R.resample(image, R.affine(0, 1, (0, 0), (0, 0)), (20, 20))
    blurred = sum(w * image[10 + dy, 10 + dx] for dy, dx, w in taps)
    assert same[10, 10] == pytest.approx(blurred, rel=1e-9) and math.isnan(same[0, 0])
    # Twice as coarse: each pixel holds the light of four.
    coarse = R.resample(np.full((40, 40), 3.0), R.affine(0, 2, (0.5, 0.5), (0, 0)), (20, 20), strict=False)
    assert coarse == pytest.approx(np.full((20, 20), 12.0))
    wrapped = R.resample(image, lambda x, y: ((x + 15) % 20, y), (20, 20), cyclic=True)
    assert np.isfinite(wrapped[5:15]).all()
    assert wrapped[10, 5] == pytest.approx(same.copy()[10, 0] if np.isfinite(same[10, 0]) else R.resample(image, lambda x, y: (x, y), (20, 20), cyclic=True)[10, 0])
    holed = image.copy()
    holed[10, 10] = np.nan
    assert math.isnan(R.resample(holed, R.affine(0, 1, (0, 0), (0, 0)), (20, 20))[11, 11])


def test_closing_fills_a_gap():
    from nightloom.functions import resample as R

    mask = np.zeros((9, 9), bool)
    mask[3:6, 2] = mask[3:6, 4] = True
    assert R.closed(mask, 1)[4, 3] and R.closed(mask, 1).sum() == 7 and R.closed(mask, 0).sum() == 6


# --- the map end to end

_IMAGES = "image_id long, ny int, nx int, data array<double>, wcs struct<kind:string,crpix:array<double>,crval:array<double>,cdelt:array<double>,pc:array<double>,pv:array<double>>"


def _image(k, data, kind="CAR", crpix=(1.0, 1.0), crval=(0.0, 0.0), cdelt=(1.0, 1.0), pc=None, pv=None):
    return (k, data.shape[0], data.shape[1], data.ravel().tolist(), (kind, list(crpix), list(crval), list(cdelt), pc, pv))


def _turn_matrix(degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [c, -s, s, c]


@pytest.mark.parametrize(
    "own", [Projection("ZPN", (20.5, 15.5), (200.0, 35.0), (-0.3, 0.3), tuple(_turn_matrix(25)), (0.0, 1.0, 0.0, 0.05)), Projection("ZPN", (20.5, 15.5), (10.0, -60.0), (0.3, 0.3), (1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.01)), Projection("CAR", (20.5, 15.5), (90.0, 30.0), (1.0, 1.0))]
)
def test_projections_return_to_the_pixel(own):
    y, x = np.mgrid[:30, :40].astype(float)
    u, v = own.world_to_pixel(*own.pixel_to_world(x, y))
    assert u == pytest.approx(x, abs=1e-8) and v == pytest.approx(y, abs=1e-8)
    ra, dec = own.pixel_to_world(np.array(own.crpix[0] - 1), np.array(own.crpix[1] - 1))
    assert (float(ra), float(dec)) == pytest.approx(own.crval)


def test_header_becomes_a_projection():
    cards = {"CTYPE1A": "RA---ZPN", "CRPIX1A": "3", "CRPIX2A": "4", "CRVAL1A": "10", "CRVAL2A": "20", "CDELT1A": "-.5", "CDELT2A": ".5", "PC1_2A": "0.1", "PV2_1A": "1", "PV2_3A": "0.2"}
    assert Projection.of_header(cards, "A") == Projection("ZPN", (3.0, 4.0), (10.0, 20.0), (-0.5, 0.5), (1.0, 0.1, 0.0, 1.0), (0.0, 1.0, 0.0, 0.2))


def test_bounds_of_images():
    grid, own, shape = Projection("CAR", (1.0, 1.0), (0.0, 0.0), (1.0, 1.0)), Projection("CAR", (1.0, 1.0), (0.1, 0.1), (1.0, 1.0)), (12, 10)
    upright = Projection("CAR", (1.0, 1.0), (0.1, 0.0), (1.0, 1.0))
    assert find_bounds(upright, shape, grid) == [(-1, 10, -1, 12)]
    assert find_bounds(upright, shape, grid, trim=(1, 2, 4, 5)) == [(0, 8, 3, 7)]
    assert find_bounds(own, shape, grid) == [(-1, 10, -1, 12)] and find_bounds(own, shape, grid, trim=(1, 2, 4, 5)) == [(0, 8, 3, 7)]
    # A frame turned by 45 degrees: RA limits cut y, Dec limits cut x.
    turned = Projection("CAR", (1.0, 1.0), (8.1, 0.1), (1.0, 1.0), tuple(_turn_matrix(45)))
    assert find_bounds(turned, shape, grid) == [(-1, 16, -1, 15)]
    assert find_bounds(turned, shape, grid, sky=(31, 35, 32, 36)) == []
    assert find_bounds(turned, shape, grid, sky=(1, 5, None, None)) == [(-1, 16, 2, 14)]
    assert find_bounds(turned, shape, grid, sky=(None, None, 2, 6)) == [(1, 15, -1, 15)]
    straddling = find_bounds(Projection("CAR", (1.0, 1.0), (355.5, 0.0), (1.0, 1.0)), shape, Projection.of_grid(wcs.default_grid(1.0)), wrap_aware=True)
    assert sorted(b[:2] for b in straddling) == [(0, 5), (354, 360)] or len(straddling) == 2


def test_map_of_turned_images_is_the_sky_whatever_the_tiles(spark):
    """A smooth sky seen by turned ZPN images comes back, in one strip or many, by blocks or by boxes."""
    sky_of = lambda ra, dec: 10 + 3 * np.sin(np.deg2rad(ra * 4)) + 2 * np.cos(np.deg2rad(dec * 5))
    grid = wcs.CarGrid((1.0, 1.0), (0.0, 0.0), (0.5, 0.5), (41, 61)).cropped(-10, -20, (60, 80))
    rows = []
    for k in range(6):
        own = Projection("ZPN", (25.5, 20.5), (8.0 + k, 4.0 + k % 3), (0.5, 0.5), tuple(_turn_matrix(20 * k)), (0.0, 1.0, 0.0, 0.02))
        y, x = np.mgrid[:40, :50].astype(float)
        rows.append(_image(k, sky_of(*own.pixel_to_world(x, y)), "ZPN", own.crpix, own.crval, own.cdelt, list(own.pc), list(own.pv)))
    images = spark.createDataFrame(rows, _IMAGES)
    target = Projection.of_grid(grid)
    made = []
    for strip, block in ((16, None), (3, None), (16, (8, 8))):
        out = sky.build_map(images, {"low": F.percentile("v", F.lit(0.5)), "fit": lambda v: v.mean()}, grid, frame_count=True, attribution=True, block=block, strip=strip).toPandas()
        made.append({(r.reducer_id, r.y, r.x): (round(r.value, 9), r.frame_count, r.attribution) for r in out.itertuples()})
    assert made[0] == made[1] and len(made[0]) > 2000
    assert all(made[0][k] == v for k, v in made[2].items() if v[1] == made[0][k][1]) and len(made[2]) > 1000
    ra, dec = target.pixel_to_world(np.array([k[2] for k in made[0]], float), np.array([k[1] for k in made[0]], float))
    # Flux is conserved, so a pixel of the map holds the light of its own area.
    assert np.array([v[0] for v in made[0].values()]) == pytest.approx(sky_of(ra, dec) * np.cos(np.deg2rad(dec)), rel=0.02)
    assert {v[2] for v in made[0].values()} <= set(range(6))
    # And the map taken off an image leaves nothing but the edges' blur.
    low = spark.createDataFrame([(k[1], k[2], v[0]) for k, v in made[0].items() if k[0] == "low"], "y int, x int, value double")
    rest = sky.subtract_map(images, low, grid, tile=16).toPandas()
    inner = rest[rest.y.between(3, 36) & rest.x.between(3, 46)].dropna()
    assert len(rest) == 6 * 2000 and len(inner) > 5000 and inner.remnant.abs().max() < 0.15
    halved = sky.Processor(preprocess=lambda rows: rows.filter("image_id < 2"), postprocess_estimate=lambda rows: rows.withColumn("v", F.col("v") / 2))
    half = sky.subtract_map(images, low, grid, halved).toPandas()
    both = rest[rest.image_id < 2].merge(half, on=["image_id", "y", "x"]).dropna()
    assert len(half) == 4000 and both.estimate_y.to_numpy() == pytest.approx(both.estimate_x.to_numpy() / 2)


def test_grid_covers_what_the_images_do(spark):
    rows = [_image(k, np.ones((12, 10)), crval=(100.0 + k, 0.0), crpix=(1.0, 11.0)) for k in range(20)]
    grid = sky.plan_grid(spark.createDataFrame(rows, _IMAGES), 1.0)
    assert (grid.shape, grid.crpix) == ((12, 360), (180.5, 11.5))
    assert sky.plan_grid(spark.createDataFrame(rows, _IMAGES), 0.2, (149, 188), (-19, 24)).shape == (215, 195)


def test_grids_of_bounds_and_of_coverage(spark):
    rows = [_image(15, np.ones((12, 10)), crval=(100.0, 0.0), crpix=(1.0, 11.0)), _image(16, np.ones((12, 10)), crval=(140.0, 0.0), crpix=(1.0, -29.0))]
    images = spark.createDataFrame(rows, _IMAGES)
    cut = sky.plan_grid(images, 0.2, (149, 188), (-19, 24))
    assert cut.shape == (215, 195) and (round(cut.crpix[0], 6), round(cut.crpix[1], 6)) == (156.5, 96.5)
    whole = sky.plan_grid(images, 1.0)  # both images, 40 degrees apart
    boxes = sky.image_bounds(images, wcs.default_grid(1.0)).collect()
    assert whole.shape == (max(b.ymax for b in boxes) - min(b.ymin for b in boxes), 360) and len(boxes) == 2
    assert sky.build_map(images, {"n": F.count("v")}, whole).filter("value > 0").count() == 2 * 7 * 5
    over = sky.plan_grid(images, 1.0, (350, 370), (-5, 5))
    at = Projection.of_grid(over).world_to_pixel(np.array([350.5, 0.5, 9.5]), np.zeros(3))[0]
    assert over.shape == (10, 20) and at == pytest.approx([1, 11, 20])
    assert sky.plan_grid(images, 1.0, (-10, 10), (-5, 5)).shape == (10, 20)
    with pytest.raises(ValueError):
        sky.plan_grid(images, 1.0, (20, 10))
    ends = spark.createDataFrame([_image(k, np.ones((4, 6)), crval=(ra, 0.0), crpix=(1.0, 1.0)) for k, ra in enumerate((355.5, 2.5, 300.5))], _IMAGES)
    covered = sky.plan_grid(ends, 1.0, "covered")
    assert covered.shape == (4, 69) and Projection.of_grid(covered).world_to_pixel(np.array([300.5]), np.zeros(1))[0] == pytest.approx([1.0])


def test_planes_are_maps_of_their_own(spark):
    rng = np.random.default_rng(2)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (20, 20))
    planes = rng.normal(size=(3, 2, 14, 14)) + 50
    own = [Projection("CAR", (1.0 - k, 1.0), (100.0, 0.0), (1.0, 1.0)) for k in range(3)]
    both = [(k, 14, 14, planes[k].ravel().tolist(), ("CAR", list(own[k].crpix), list(own[k].crval), list(own[k].cdelt), None, None)) for k in range(3)]
    together = spark.createDataFrame(both, _IMAGES)
    reducers = {"mean": F.avg("v"), "least": lambda v: v.min()}
    made = sky.build_map(together, reducers, grid, frame_count=True, attribution=True, planes=True)
    left = sky.subtract_map(together, made.filter("reducer_id = 'mean'"), grid, planes=True).toPandas()
    made = made.toPandas()
    for p in (0, 1):
        alone = spark.createDataFrame([_image(k, planes[k, p], crpix=own[k].crpix, crval=own[k].crval) for k in range(3)], _IMAGES)
        one = sky.build_map(alone, reducers, grid, frame_count=True, attribution=True)
        key = ["reducer_id", "y", "x"]
        a, b = made[made.plane == p].drop(columns="plane").sort_values(key).reset_index(drop=True), one.toPandas().sort_values(key).reset_index(drop=True)
        assert len(a) > 200 and a[b.columns].round(9).equals(b.round(9))
        rest = sky.subtract_map(alone, one.filter("reducer_id = 'mean'"), grid).toPandas().sort_values(["image_id", "y", "x"]).reset_index(drop=True)
        same = left[left.plane == p].drop(columns="plane").sort_values(["image_id", "y", "x"]).reset_index(drop=True)
        assert same[rest.columns].round(9).equals(rest.round(9)) and rest.remnant.notna().sum() > 30
    with pytest.raises(Exception, match="several planes"):
        sky.build_map(together, reducers, grid).collect()


def test_map_of_several_values_is_not_subtracted(spark):
    images = spark.createDataFrame([_image(1, np.ones((12, 12)), crval=(100.0, 0.0))], _IMAGES)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (12, 12))
    made = sky.build_map(images, {"low": F.min("v"), "high": F.max("v")}, grid)
    with pytest.raises(Exception, match="several values"):
        sky.subtract_map(images, made, grid).collect()
    assert sky.subtract_map(images, made.filter("reducer_id = 'low'"), grid).filter("remnant IS NOT NULL").count() > 0


def test_stack_is_resampled_once(spark):
    images = spark.createDataFrame([_image(k, np.full((12, 12), float(k)), crval=(100.0, 0.0)) for k in range(3)], _IMAGES)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (12, 12))
    made = sky.build_map(images, {"low": F.min("v"), "mean": F.avg("v"), "kernel": lambda v: (v.max(), v.min())}, grid, frame_count=True, attribution=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "") and "Scan parquet" in plan
    found = made.collect()
    assert {(r.reducer_id, r.output_idx, r.attribution) for r in found} == {("low", 0, 0), ("mean", 0, 1), ("kernel", 0, 2), ("kernel", 1, 0)} and {r.frame_count for r in found} == {3}


def test_samples_may_be_changed_on_the_way(spark):
    images = spark.createDataFrame([_image(k, np.full((12, 12), float(k or 0)), crval=(100.0, 0.0)) for k in (0, 1, None)], _IMAGES)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (12, 12))
    twice = sky.Processor(preprocess=lambda rows: rows.withColumn("data", F.coalesce("data", F.array())), postprocess_samples=lambda s: s.withColumn("v", F.col("v") + 10).unionByName(s.filter("image_id = 1 AND x = 5")))
    reducers = {"most": F.max("v"), "kernel": lambda v: v.max()}
    plain = {(r.reducer_id, r.y, r.x): r for r in sky.build_map(images, reducers, grid, frame_count=True, attribution=True).collect()}
    found = {(r.reducer_id, r.y, r.x): r for r in sky.build_map(images, reducers, grid, twice, frame_count=True, attribution=True, strip=5).collect()}
    assert found.keys() == plain.keys() and len(found) == 2 * 64
    for k, r in found.items():
        assert r.value == pytest.approx(plain[k].value + 10) and r.frame_count == 3 + (k[2] == 5) and r.attribution == plain[k].attribution == 1


def test_deep_fields_are_cut_into_narrower_stretches(spark):
    """Of 60 images on one spot and one elsewhere; rows are those of the plain map, and no group is over the target."""
    rng = np.random.default_rng(9)
    rows = [_image(k, rng.normal(size=(12, 12)), crval=(100.0, 0.0)) for k in range(60)] + [_image(99, np.ones((12, 12)), crval=(140.0, 0.0))]
    images, grid = spark.createDataFrame(rows, _IMAGES), wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (12, 60))
    reducers = {"middle": lambda v: float(np.median(v)), "mean": F.avg("v")}
    made = [sorted(map(str, sky.build_map(images, reducers, grid, frame_count=True, attribution=True, target_bytes=n).select("reducer_id", "y", "x", F.round("value", 9), "frame_count", "attribution").collect())) for n in (2**28, 60 * 4 * 8)]
    assert made[0] == made[1] and len(made[0]) == 4 * 64
    stretches = stack.narrowed(sky.resampled(images, grid), 16, 60 * 4 * 8)
    assert stretches.groupBy("plane", "y", "x0").agg(F.sum(F.size("values")).alias("n")).agg(F.max("n")).first()[0] <= 60 * 4


def test_blocks_by_a_test_of_ones_own(spark):
    images = spark.createDataFrame([_image(1, np.where(np.arange(400).reshape(20, 20) % 20 < 10, 1.0, 0.0), crval=(100.0, 0.0))], _IMAGES)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (20, 20))
    made = lambda **kw: {(r.y, r.x) for r in sky.build_map(images, {"n": F.count("v")}, grid, block=(5, 5), **kw).collect()}
    light, mine = made(), made(good_block=lambda image, at: image.shape == (1, 20, 20) and at[1] < 10)
    assert max(x for _, x in light) < 15 <= max(x for _, x in mine) and max(y for y, _ in mine) < 10 <= max(y for y, _ in light)


def test_folders_are_loaded_by_the_processor(spark, tmp_path):
    cards = {"CTYPE1": "'RA---CAR'", "CTYPE2": "'DEC--CAR'", "CRPIX1": "1", "CRPIX2": "1", "CRVAL1": "100", "CRVAL2": "0", "CDELT1": "1", "CDELT2": "1"}
    _fits(tmp_path / "a.fits", np.full((12, 12), 3.0), cards)
    grid = wcs.CarGrid((1.0, 1.0), (100.0, 0.0), (1.0, 1.0), (12, 12))
    doubled = sky.Processor(load=lambda spark, path: fits.images(spark, path).withColumn("data", F.transform("data", lambda v: v * 2)))
    for processor, want in ((sky.Processor(), 3.0), (doubled, 6.0)):
        made = sky.build_map(str(tmp_path), {"mean": F.avg("v")}, grid, processor)
        assert [r.value for r in made.collect()] == pytest.approx([want] * 64)
        rest = sky.subtract_map(str(tmp_path), made, grid, processor)
        assert rest.filter("source <> %s" % want).isEmpty() and rest.filter("abs(remnant) < 1e-9").count() == 16
    raw = sky.raw_stack(str(tmp_path), grid, (4, 7)).collect()
    assert {(r.y, r.x) for r in raw} == {(y, x) for y in range(2, 10) for x in range(4, 7)}
    fitted = sky.build_map(str(tmp_path), None, None, doubled)
    assert {r.reducer_id for r in fitted.collect()} == {"gaussian"}


def test_bounds_of_lists_with_trims(spark):
    grid = wcs.CarGrid((1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (60, 60))
    one = spark.createDataFrame([_image(1, np.ones((12, 10)), crpix=(1.0, 1.0), crval=(5.1, 0.0))], _IMAGES)
    two = spark.createDataFrame([_image(2, np.ones((12, 10)), crpix=(1.0, -19.0), crval=(20.1, 0.0))], _IMAGES)
    box = lambda images, trim: find_bounds(Projection.of_row(images.first().wcs.asDict()), (12, 10), Projection.of_grid(grid), trim)[0]
    for trims in ([(0, 0, 0, 0)], [(1, 2, 3, 4), (2, 1, 0, 5)]):
        a, b = box(one, trims[0]), box(two, trims[-1])
        assert tuple(sky.collective_bounds([one, two], grid, trims).first()) == (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
    own = one.withColumn("trim", F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]))
    assert tuple(sky.image_bounds(own, grid, "trim").select("xmin", "xmax", "ymin", "ymax").first()) == box(one, (1, 2, 3, 4))


def test_star_lookups(spark):
    table = spark.createDataFrame([(1, 0.5, 10.0), (2, 359.5, 10.0), (3, 2.9, 10.5), (4, 3.1, 10.5), (5, 100.0, 90.0), (6, 101.9, 88.0)], "star_id int, ra double, dec double")
    ids = lambda df: sorted(r.star_id for r in df.collect())
    assert ids(stars.stars_at(table, 1.0, 11.0)) == [1, 3] and ids(stars.stars_at(table, 100.5, 90.0)) == [5, 6]
    assert ids(stars.stars_between(table, [(358.0, 359.0), (0.0, 0.1)], 9.0, 9.5)) == [1, 2, 3]


def test_stored_maps_are_read_by_tile(spark, tmp_path):
    images = spark.createDataFrame([_image(k, np.full((12, 12), 1.0 + k), crval=(ra, 0.0)) for k, ra in enumerate((0.0, 90.0, 200.0))], _IMAGES)
    grid = wcs.CarGrid((1.0, 13.0), (180.0, 0.0), (1.0, 1.0), (40, 360)).cropped(-180, 0, (40, 360))
    made = sky.build_map(images, {"low": F.min("v")}, grid)
    path = f"{tmp_path}/map"
    sky.save_map(made, grid, path, 16, {"scale": "1"})
    with pytest.raises(Exception):
        sky.save_map(made, grid, path, 16)
    stored = sky.load_map(spark, path)
    assert (stored.grid, stored.tile, stored.meta) == (grid, 16, {"scale": "1"})
    some = images.filter("image_id <> 1")
    near = stored.around(some)
    assert "PartitionFilters: [" in near._jdf.queryExecution().executedPlan().toString() and 0 < near.count() < stored.rows.count()
    clean = lambda df: df.toPandas().sort_values(["image_id", "y", "x"]).reset_index(drop=True).round(9)
    whole = clean(sky.subtract_map(some, made, grid))
    assert clean(sky.subtract_map(some, near, stored.grid)).equals(whole) and whole.remnant.notna().sum() > 20


def test_image_of_the_whole_sky_on_an_oblique_grid(spark):
    """A constant brightness comes back wherever there is a value, at the seam and about the poles as well, and soon."""
    import time

    from nightloom.functions import resample as R

    target, want = Projection("CAR", (180.5, 25.5), (90.0, 30.0), (1.0, 1.0)), np.cos(np.deg2rad(np.arange(50) - 24.5))[:, None] * np.ones(360)
    for scale in (4.0, 0.4):
        nx, ny = int(360 / scale), int(180 / scale)
        own = Projection("CAR", (nx / 2 + 0.5, ny / 2 + 0.5), (180.0, 0.0), (scale, scale))
        y, x = np.mgrid[:ny, :nx].astype(float)
        image = np.cos(np.deg2rad(own.pixel_to_world(x, y)[1])) * scale**2
        mapping = lambda x, y, own=own: own.world_to_pixel(*target.pixel_to_world(x, y))
        began = time.perf_counter()
        for strict, cyclic, least in ((True, False, 0.9), (False, False, 1.0), (True, True, 0.99), (False, True, 1.0)):
            out = R.resample(image, mapping, (50, 360), strict=strict, cyclic=cyclic)
            good = np.isfinite(out)
            assert good.mean() >= least and out[good] == pytest.approx(want[good], rel=0.01) and out[good].sum() == pytest.approx(want[good].sum(), rel=0.003)
        assert time.perf_counter() - began < 5
        # No pixel depends on what is resampled with it.
        part = R.resample(image, lambda x, y, m=mapping: m(x + 150, y + 20), (10, 60))
        whole = R.resample(image, mapping, (50, 360))[20:30, 150:210]
        assert np.allclose(part, whole, rtol=1e-12, atol=0, equal_nan=True)
    images = spark.createDataFrame([_image(7, image, crpix=own.crpix, crval=own.crval, cdelt=own.cdelt)], _IMAGES)
    grid = wcs.CarGrid((180.5, 25.5), (90.0, 30.0), (1.0, 1.0), (50, 360))
    assert sky.build_map(images, {"mean": F.avg("v")}, grid).count() > 17000


def test_pole_of_a_map_in_an_image():
    from nightloom.functions import resample as R

    nx, ny = 1800, 900
    own, image = Projection("CAR", (nx / 2 + 0.5, ny / 2 + 0.5), (180.0, 0.0), (0.2, 0.2)), np.cos(np.deg2rad(np.arange(900) * 0.2 - 89.9))[:, None] * np.ones(1800) * 0.04
    target = Projection("ZPN", (50.5, 50.5), (10.0, 89.0), (0.1, 0.1), (1.0, 0.0, 0.0, 1.0), (0.0, 1.0))
    out = R.resample(image, lambda x, y: own.world_to_pixel(*target.pixel_to_world(x, y)), (100, 100), strict=False, cyclic=True)
    assert np.isfinite(out).all() and np.median(out) == pytest.approx(0.01, rel=0.02) and np.quantile(np.abs(out / 0.01 - 1), 0.95) < 0.05


@pytest.mark.parametrize("crval,pole", [((90.0, -30.0), (None, 90.0)), ((90.0, 30.0), (40.0, 90.0)), ((90.0, -30.0), (150.0, 90.0)), ((90.0, 10.0), (60.0, -90.0)), ((90.0, 0.0), (180.0, 90.0)), ((90.0, 0.0), (30.0, 90.0)), ((90.0, 0.0), (90.0, 60.0))])
def test_general_poles_return_to_the_pixel(crval, pole):
    own = Projection("CAR", (20.5, 15.5), crval, (1.0, 1.0), pole=pole)
    y, x = np.mgrid[:30, :40].astype(float)
    u, v = own.world_to_pixel(*own.pixel_to_world(x, y))
    assert u == pytest.approx(x, abs=1e-8) and v == pytest.approx(y, abs=1e-8)
    ra, dec = own.pixel_to_world(np.array(19.5), np.array(14.5))
    assert (float(ra), float(dec)) == pytest.approx(crval, abs=1e-9)


def test_southern_grids_as_columns_equal_the_kernel(spark):
    grid = wcs.CarGrid((180.5, 90.5), (90.0, -30.0), (1.0, 1.0), (180, 360))
    points = spark.range(1, 200).select((F.col("id") * 1.7 % 360).alias("ra"), (F.col("id") * 0.83 % 160 - 80).alias("dec"))
    x, y = wcs.world_to_pixel(F.col("ra"), F.col("dec"), grid)
    found = points.select("*", x.alias("x"), y.alias("y")).toPandas()
    u, v = Projection.of_grid(grid).world_to_pixel(found.ra.to_numpy(), found.dec.to_numpy())
    assert found.x.to_numpy() == pytest.approx(u, abs=1e-9) and found.y.to_numpy() == pytest.approx(v, abs=1e-9)


def test_headers_of_other_forms():
    base = {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR", "CRPIX1": "3", "CRPIX2": "4", "CRVAL1": "10", "CRVAL2": "20"}
    assert Projection.of_header({**base, "CD1_1": "-.5", "CD1_2": ".1", "CD2_2": ".5"}) == Projection("CAR", (3.0, 4.0), (10.0, 20.0), (1.0, 1.0), (-0.5, 0.1, 0.0, 0.5))
    swapped = {"CTYPE1": "DEC--CAR", "CTYPE2": "RA---CAR", "CRPIX1": "3", "CRPIX2": "4", "CRVAL1": "20", "CRVAL2": "10", "CDELT1": ".5", "CDELT2": "-.5", "LONPOLE": "30"}
    own = Projection.of_header(swapped)
    ra, dec = own.pixel_to_world(np.array(2.0), np.array(3.0))
    assert own.pc == (0.0, 1.0, 1.0, 0.0) and (float(ra), float(dec)) == pytest.approx((10.0, 20.0))
    with pytest.raises(ValueError):
        Projection.of_header({**base, "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN"})
    with pytest.raises(ValueError):
        Projection.of_header({**base, "LONPOLE": "85", "CRVAL2": "60"})
    assert Projection.of_row_or_none({"kind": "TAN", "crpix": [1, 1], "crval": [0, 0], "cdelt": [1, 1], "pc": None, "pv": None}) is None


def test_histogram_of_odd_groups(spark):
    rows = [("a", 1.0), ("a", 5.0), ("a", float("nan")), ("one", 3.0), ("one", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("inf", float("inf")), ("inf", 1.0)]
    found = {(r.k, r.bin): r.n for r in stack.histogram(spark.createDataFrame(rows, "k string, v double"), "k", 4).collect()}
    assert found == {("a", 0): 1, ("a", 3): 1, ("one", 2): 2, (None, 0): 1, (None, 3): 1, ("inf", 2): 1}


def test_clip_keeps_the_null_key_and_leaves_no_tables(spark):
    import os
    from pyarrow import fs
    from nightloom.sources import tables

    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in (1, None) for v in rng.standard_t(2, 300)]
    folder = fs.FileSystem.from_uri(tables.shared_folder(spark))[1]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = {r.k: r.value for r in stack.clip_by_rounds(spark.createDataFrame(rows, "k int, v double"), "k", 2.0, 10).collect()}
    for k in (1, None):
        assert found[k] == pytest.approx(reducers.clipped_mean(np.array([v for j, v in rows if j == k]), 2.0, 10))
    assert len([n for n in set(os.listdir(folder)) - before if n.startswith("clip")]) == 1  # the result's own


def test_frame_without_width(spark):
    frames_ = spark.createDataFrame([(1, "c", 30.0, 10.0, 0.0), (2, "c", 0.5, 10.0, 2.0), (3, "c", None, 1.0, 1.0)], "image_id int, camera string, ra0 double, dec0 double, half double")
    found = sorted(map(tuple, geometry.frame_boxes(frames_, 50, wcs.default_grid(1.0)).collect()))
    assert found == sorted(map(tuple, geometry.bounds(geometry.edge_points(frames_.filter("ra0 IS NOT NULL"), 50), wcs.default_grid(1.0)).collect()))
    assert [r[0] for r in found] == [1, 2, 2]


@pytest.mark.parametrize("exact_below", [100_000, 50, 1])
def test_quantiles_of_one_large_group(spark, exact_below):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.pareto(0.3, 1000), [np.nan, np.inf, -np.inf]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.001, 0.3, 0.5, 0.61, 0.9999, 1.0]
    found = stack.quantiles(rows, shares, exact_below=exact_below).collect()
    assert [r.share for r in found] == shares and [r.value for r in found] == pytest.approx(np.quantile(values[np.isfinite(values)], shares).tolist(), rel=1e-12)
    assert [r.value for r in stack.quantiles(rows.limit(0), [0.5]).collect()] == [None]
    wide = spark.createDataFrame([(v,) for v in (-1.7e308, -1.0, 0.0, 2.0, 1.7e308)], "v double")
    assert [r.value for r in stack.quantiles(wide, [0.0, 0.25, 0.5, 1.0], exact_below=exact_below).collect()] == [-1.7e308, -1.0, 0.0, 1.7e308]


def _fits(path, data, cards):
    head = {"SIMPLE": "T", "BITPIX": "-64", "NAXIS": str(data.ndim), **{f"NAXIS{k}": str(n) for k, n in enumerate(data.shape[::-1], 1)}, **cards}
    raw = "".join(f"{n:<8}= {v:>20}".ljust(80) for n, v in head.items()) + "END".ljust(80)
    path.write_bytes(raw.ljust(-(-len(raw) // 2880) * 2880).encode() + data.astype(">f8").tobytes().ljust(-(-data.nbytes // 2880) * 2880, b"\0"))


def test_headers_are_read_without_data(spark, tmp_path):
    sky_cards = {"CTYPE1": "'RA---CAR'", "CTYPE2": "'DEC--CAR'", "CRPIX1": "1", "CRPIX2": "1", "CRVAL1": "100", "CRVAL2": "0", "CDELT1": "1", "CDELT2": "1"}
    _fits(tmp_path / "a.fits", np.ones((2, 300, 200)), sky_cards)
    _fits(tmp_path / "b.fits", np.ones((12, 10)), {**sky_cards, "CRVAL1": "120"})
    _fits(tmp_path / "c.fits", np.ones((12, 10)), {**sky_cards, "CTYPE1": "'RA---TAN'", "CTYPE2": "'DEC--TAN'"})
    (tmp_path / "d.fits").write_bytes(b"nothing")
    found = fits.headers(spark, str(tmp_path))
    rows = {r.image_id: r for r in found.collect()}
    assert [rows[k].bytes_read for k in range(3)] == [2880] * 3 and (rows[0].planes, rows[0].ny, rows[0].nx) == (2, 300, 200)
    assert rows[0].problem is None and "TAN" in rows[2].problem and rows[2].wcs is None and rows[3].problem == "no data"
    grid = sky.plan_grid(found.filter("image_id = 1"), 1.0)
    images = fits.images(spark, str(tmp_path))
    assert {(r.image_id, r.plane): r.problem is None for r in images.select("image_id", "plane", "problem").collect()} == {(0, 0): True, (0, 1): True, (1, 0): True, (2, 0): False, (3, 0): False}
    assert sky.build_map(images.filter("image_id > 0"), {"mean": F.avg("v")}, grid).count() == 7 * 5
    assert [len(r.data) for r in fits.images(spark, str(tmp_path), split=False).filter("image_id = 0").collect()] == [120000]


def test_subtracted_images_become_fits_files(spark, tmp_path):
    cards = {"CTYPE1": "'RA---CAR'", "CTYPE2": "'DEC--CAR'", "CRPIX1": "1", "CRPIX2": "1", "CRVAL1": "100", "CRVAL2": "0", "CDELT1": "1", "CDELT2": "1", "OBSERVER": "'O''Neil'"}
    for k in range(3):
        _fits(tmp_path / f"i{k}.fits", np.arange(2 * 144.0).reshape(2, 12, 12) + k, {**cards, "CRVAL1": str(100 + k)})
    images = fits.images(spark, str(tmp_path), split=False)
    grid = sky.plan_grid(images, 1.0, "covered")
    made = sky.build_map(images, {"low": F.min("v")}, grid, planes=True)
    rest = sky.subtract_map(images, made, grid, planes=True)
    out = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    table = sky.subtracted_images(rest, images)
    fits.write(table, out)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["i0.fits", "i1.fits", "i2.fits"]
    back = {r.image_id: r for r in fits.images(spark, str(tmp_path / "out"), split=False).collect()}
    want = rest.toPandas().sort_values(["image_id", "plane", "y", "x"])
    for k, r in back.items():
        assert np.array_equal(np.array(r.data), want[want.image_id == k].remnant.to_numpy(), equal_nan=True) and r.problem is None
        assert r.meta["OBSERVER"] == "O'Neil" and r.wcs.crval[0] == 100 + k and b"HISTORY background subtracted: remnant" in (tmp_path / "out" / f"i{k}.fits").read_bytes()
    with pytest.raises(Exception, match="exist"):
        fits.write(table, out)
    before = (tmp_path / "out" / "i0.fits").read_bytes()
    bad = table.withColumn("ny", F.when(F.col("image_id") == 2, F.lit(11)).otherwise(F.col("ny"))).withColumn("name", F.concat(F.lit("new-"), "name"))
    with pytest.raises(Exception):
        fits.write(bad, out)
    fits.write(table.withColumn("data", F.transform("data", lambda v: v * 0)), out, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names and (tmp_path / "out" / "i0.fits").read_bytes() != before


def test_stars_in_turned_frames(spark):
    rng = np.random.default_rng(5)
    own = Projection("ZPN", (10.5, 8.5), (359.0, 10.0), (0.5, 0.5), tuple(_turn_matrix(30)), (0.0, 1.0))
    images = spark.createDataFrame([_image(1, np.ones((16, 20)), "ZPN", own.crpix, own.crval, own.cdelt, list(own.pc), list(own.pv))], _IMAGES)
    ra, dec, mag = rng.uniform(0, 360, 4000), rng.uniform(-90, 90, 4000), rng.uniform(0, 9, 4000)
    ra[:2000], dec[:2000] = (ra[:2000] / 20 - 10) % 360, dec[:2000] / 9 + 10
    found = stars.in_image_frames(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(zip(ra, dec, mag))], "star_id long, ra double, dec double, vmag double"), images, wcs.default_grid(1.0), 2.0, 8.0, (1, 2, 3, 4))
    x, y = own.world_to_pixel(ra, dec)
    with np.errstate(invalid="ignore"):
        want = np.flatnonzero((1 < x) & (x < 18) & (3 < y) & (y < 12) & (mag > 2) & (mag < 8))
    assert sorted(r.star_id for r in found.collect()) == want.tolist() and len(want) > 50


def test_stars_meet_frames_of_many_images(spark, capsys):
    """Images of one wcs share a frame, absent parts of a wcs are alike, and pairs that meet in a bin aren't moved."""
    own = Projection("ZPN", (10.5, 8.5), (359.0, 10.0), (0.5, 0.5), tuple(_turn_matrix(30)), (0.0, 1.0))
    turned = [_image(k, np.ones((16, 20)), "ZPN", own.crpix, own.crval, own.cdelt, list(own.pc), list(own.pv)) for k in (7, 3)]
    images = spark.createDataFrame([*turned, *[_image(k, np.ones((16, 20)), "CAR", (1.0, 1.0), (350.0, 0.0), (0.5, 0.5), None, None) for k in (5, 9, 4)]], _IMAGES)
    rng = np.random.default_rng(6)
    ra, dec = rng.uniform(-12, 10, 1500) % 360, rng.uniform(-3, 15, 1500)
    found = stars.in_image_frames(spark.createDataFrame([(k, float(a), float(d), 5.0) for k, (a, d) in enumerate(zip(ra, dec))], "star_id long, ra double, dec double, vmag double"), images, wcs.default_grid(1.0), 2.0, 8.0, (1, 2, 3, 4))
    want = []
    for p, ids in ((own, (3, 7)), (Projection("CAR", (1.0, 1.0), (350.0, 0.0), (0.5, 0.5)), (4, 5, 9))):
        x, y = p.world_to_pixel(ra, dec)
        want += [(i, k) for i in ids for k in np.flatnonzero((1 < x) & (x < 18) & (3 < y) & (y < 12)).tolist()]
    assert sorted((r.image_id, r.star_id) for r in found.collect()) == sorted(want) and len(want) > 300
    found.explain()
    assert "CoGroups" not in capsys.readouterr().out


def test_photometry_writes_stars_of_frames_with_cut_outs(spark, monkeypatch):
    """The written table has no row for each image, nor stars near the edge; stars that round to one pixel share its apertures."""
    images = spark.createDataFrame([_image(k, np.ones((9, 9)), "CAR", (1.0, 1.0), (350.0, 0.0), (1.0, 1.0), None, None) for k in (4, 2, 8)], _IMAGES)
    rows = [(1, 354.1, 4.2, 5.0), (2, 353.9, 3.8, 6.0), (3, 351.0, 1.0, 5.0), (4, 354.0, 7.0, 5.0)]
    pixels = spark.createDataFrame([(k, y, x, *[float(k * 100 * (y == x == 4) + y)] * 4) for k in (2, 4, 8) for y in range(9) for x in range(9)], "image_id long, y int, x int, source double, blurred double, estimate double, remnant double")
    written, real = [], stars.tables.written
    monkeypatch.setattr(stars.tables, "written", lambda df, name: written.append(real(df, name)) or written[-1])
    found = stars.photometry(images, pixels, spark.createDataFrame(rows, "star_id long, ra double, dec double, vmag double"), wcs.default_grid(1.0), 2.0, 8.0, 1, 0, 1)
    assert sorted((r.image_id, r.star_id, r.orig_measured_flux, r.remnant_flux, r.exp_magnitude) for r in found.collect()) == [(k, s, 100.0 * k, 100.0 * k, m) for k in (2, 4, 8) for s, m in ((1, 5.0), (2, 6.0))]
    assert [w.count() for w in written] == [2]


def test_oblique_seam_is_where_the_arc_tangent_ends(spark):
    """A place opposite the reference point lies at longitude 180; no longitude is over it, of grids north and south."""
    places = spark.createDataFrame([(270.0, -16.33), (100.81, -90.0), (90.0, 30.0), (271.0, -16.33)], "ra double, dec double")
    north, south = (wcs.CarGrid((180.5, 25.5), (90.0, lat), (1.0, 1.0), (50, 360)) for lat in (30.0, -30.0))
    x = [r[0] for r in places.select(wcs.world_to_pixel(F.col("ra"), F.col("dec"), north)[0]).collect()]
    assert x[:3] == pytest.approx([359.5, 359.5, 179.5]) and -0.5 < x[3] < 2
    every = spark.range(3600).select((F.col("id") / 10).alias("ra"), (F.col("id") * 7 % 180 - 90).cast("double").alias("dec"))
    for grid in (north, south):
        low, high = every.select(wcs.world_to_pixel(F.col("ra"), F.col("dec"), grid)[0].alias("x")).agg(F.min("x"), F.max("x")).first()
        assert -0.5 - 1e-9 <= low and high <= 359.5 + 1e-9


def test_frames_are_spread_over_bins_without_an_aggregation(spark, capsys):
    """A frame all the way around has each bin once; equal rows of frames stay, as in SQL; no task keeps the frames' bins to compare them."""
    frames = spark.createDataFrame([(1, 10.0, 5.0, 179.5), (2, 359.0, 0.0, 200.0), (3, 100.0, 40.0, 4.0), (3, 100.0, 40.0, 4.0)], "image_id long, ra0 double, dec0 double, half double")
    sky_stars = [(k, float(ra), float(dec), 5.0) for k, (ra, dec) in enumerate((ra, dec) for ra in range(0, 360, 7) for dec in (-88, -30, 38, 42, 90))]
    found = stars.in_frames(spark.createDataFrame(sky_stars, "star_id long, ra double, dec double, vmag double"), frames, 2.0, 8.0)
    turn = lambda a: (a + 180) % 360 - 180
    want = [(r.image_id, k) for r in frames.collect() for k, ra, dec, _ in sky_stars if abs(turn(ra - r.ra0)) < r.half and abs(dec - r.dec0) < r.half]
    assert sorted((r.image_id, r.star_id) for r in found.collect()) == sorted(want)
    found.explain()
    assert "Aggregate" not in capsys.readouterr().out


def test_rounded_equals_round(spark):
    """Bit by bit, near ties too, of large values and of -0.0."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.uniform(-360, 360, 20000), rng.integers(-(10**9), 10**9, 20000) / 1e9, rng.integers(-(10**7), 10**7, 20000) / 1e7, rng.normal(0, 1e-8, 2000), rng.normal(0, 1e12, 2000), [0.0, -0.0, -1e-12, 2.5e-8, 5e-9, -5e-9, 1e300]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (6, 8):
        same = F.xxhash64(stack.rounded(F.col("v"), digits)) == F.xxhash64(F.round("v", digits) + 0.0)
        assert rows.filter(~same).count() == 0
    assert [str(r[0]) for r in rows.filter("v = 0 OR v = -1e-12").select(stack.rounded(F.col("v"), 8)).collect()] == ["0.0"] * 3


def test_stars_of_a_frame_are_rounded_once(spark, capsys):
    """Above the join with the frames' images there is nothing but the choice of columns; a frame's stars go to many keys."""
    QUERIES["stars_in_images"](spark, SF).explain()
    above, below = capsys.readouterr().out.split("Join", 1)
    assert "round(" not in above and "round(" in below and "deal" in above + below.split("\n")[0]


def test_offsets_are_rounded_only_next_to_the_edge(spark, capsys):
    """Stars on both sides of an edge, by less than a rounding too, are judged as by SQL; others by a plain comparison that stands before."""
    frames = spark.createDataFrame([(k, ra, dec, 2.5) for k, (ra, dec) in enumerate([(10.0, 5.0), (359.0, -3.0), (1.5, 88.0)])], "image_id long, ra0 double, dec0 double, half double")
    offsets = [s * (2.5 + e) for s in (-1, 1) for e in (-1, -2e-8, -1e-8, -2e-9, -6e-10, -4e-10, -1e-12, 0, 1e-12, 4e-10, 6e-10, 2e-8)]
    places = [((ra + a) % 360, dec + b) for ra, dec in ((10.0, 5.0), (359.0, -3.0), (1.5, 87.0)) for a in offsets for b in (0.0, *offsets[:12])]
    sky_stars = spark.createDataFrame([(k, ra, dec, 5.0) for k, (ra, dec) in enumerate(places)], "star_id long, ra double, dec double, vmag double")
    found = stars.in_frames(sky_stars, frames, 2.0, 8.0)
    dx, dy = F.pmod(F.col("ra") - F.col("ra0") + 180, F.lit(360.0)) - 180, F.col("dec") - F.col("dec0")
    want = sky_stars.crossJoin(frames).filter((F.round(F.abs(dx), 9) < F.col("half")) & (F.round(F.abs(dy), 9) < F.col("half"))).select("image_id", "star_id", dx, dy)
    got = sorted(map(tuple, found.select("image_id", "star_id", "dx", "dy").collect()))
    assert got == sorted(map(tuple, want.collect())) and 100 < len(got) < len(places)
    found.explain()
    join = next(line for line in capsys.readouterr().out.splitlines() if "Join" in line)
    assert "- 1.0E-8)) OR" in join and join.count("round(") == join.count("+ 1.0E-8)) AND (round(") == 2


def test_saved_tables_are_not_overwritten_unasked(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3.0)], "y int, x int, value double")
    sky.save(rows, f"{tmp_path}/map", {"scale": "1"})
    with pytest.raises(Exception):
        sky.save(rows, f"{tmp_path}/map")
    sky.save(rows, f"{tmp_path}/map", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/map").columns == ["y", "x", "value"]


def test_fits_files_become_a_map(spark, tmp_path):
    for k in range(3):
        numbers = {"CRPIX1": 8.5, "CRPIX2": 8.5, "CRVAL1": 100.0 + k, "CRVAL2": 10.0, "CDELT1": 1.0, "CDELT2": 1.0, "PV2_1": 1.0}
        cards = [f"{n:<8}= {v:>20}" for n, v in {"SIMPLE": "T", "BITPIX": -64, "NAXIS": 3, "NAXIS1": 16, "NAXIS2": 16, "NAXIS3": 2, **numbers}.items()]
        raw = "".join(c.ljust(80) for c in [*cards, "CTYPE1  = 'RA---ZPN'", "CTYPE2  = 'DEC--ZPN'", "END"]).ljust(2880).encode()
        planes = np.stack([np.full((16, 16), 5.0), np.full((16, 16), 7.0)])
        (tmp_path / f"{2 - k}.fits").write_bytes(raw + planes.astype(">f8").tobytes().ljust(5760, b"\0"))
    images = fits.images(spark, str(tmp_path))
    rows = images.select("image_id", "plane", "wcs.crval", F.size("data").alias("n"), F.array_max("data").alias("v")).collect()
    assert {(r.image_id, r.plane, r.crval[0], r.n, r.v) for r in rows} == {(2 - k, p, 100.0 + k, 256, 5.0 + 2 * p) for k in range(3) for p in (0, 1)}
    made = sky.build_map(images.filter("plane = 0"), {"mean": F.avg("v")}, wcs.default_grid(1.0), frame_count=True).collect()
    assert {r.frame_count for r in made} == {1, 2, 3} and all(r.value == pytest.approx(5 * math.cos(math.radians(r.y - 89.5)), rel=0.03) for r in made)


@pytest.mark.parametrize("name,kernel,digits", [("map_gaussian", "gaussian", 5), ("map_gaussian_amplitude", "gaussian_amplitude", 5), ("map_skew", "skew_gaussian", 4)])
def test_fitted_maps_equal_the_fit_of_each_pixel(spark, name, kernel, digits):
    from nightloom.sources import tables

    stacks = {}
    for r in tables.samples(spark, SF).collect():
        stacks.setdefault((r.y, r.x), []).append(r.v)
    for r in QUERIES[name](spark, SF).collect():
        want = reducers.KERNELS[kernel](np.array(stacks.pop((r.y, r.x)), float))
        assert r.value == (pytest.approx(want, abs=10.0**-digits) if math.isfinite(want) else None)
    assert not stacks


def test_gaussian_fits_are_the_least_of_a_grid():
    """The weighted cost of the fitted centre is no more than that of any centre and width of a fine grid."""
    rng = np.random.default_rng(11)
    for _ in range(10):
        values = rng.normal(3, 2, 300)
        kept = reducers.sigma_clip(values, 3.0, 50)
        counts, edges = np.histogram(kept, min(len(kept) // 5, 50))
        x, height = (edges[1:] + edges[:-1]) / 2, counts / (counts.sum() * (edges[1] - edges[0]))
        centre = np.linspace(2, 4, 201)[:, None, None]
        width = np.linspace(1, 3, 101)[None, :, None]
        cost = (height * (np.exp(-((x - centre) ** 2) / (2 * width**2)) / (math.sqrt(2 * math.pi) * width) - height) ** 2).sum(-1)
        best = centre[np.unravel_index(cost.argmin(), cost.shape)[0], 0, 0]
        assert reducers.gaussian_centre(values) == pytest.approx(best, abs=0.011)


def test_adaptive_resampling_query_equals_the_kernel(spark):
    from nightloom.functions import resample as R

    data = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 40").collect()}
    found = {}
    for r in QUERIES["resample_adaptive"](spark, SF).filter("image_id < 40").collect():
        found.setdefault(r.image_id, {})[r.y, r.x] = r.v
    for k, image in data.items():
        out = R.resample(image, R.affine(15.0 * (k % 7), 0.8 + 0.1 * (k % 5), (3.5, 3.5), (5.5, 5.5)), (12, 12), strict=False)
        assert found[k] == {(int(y), int(x)): pytest.approx(out[y, x], abs=1e-6) for y, x in zip(*np.nonzero(np.isfinite(out)))}
