"""Sensor models, metadata, ortho images, control points and displacement on made-up orbits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.kernels import bspline, geodesy, pushbroom, sinc
from rasterloom.operators import displacement, gcps, ortho, sensors
from rasterloom.plans import correlation, imagery
from rasterloom.plans.catalogue import MODEL
from rasterloom.sources import metadata


def test_splines_reproduce_polynomials_and_samples():
    rng = np.random.default_rng(0)
    x, q = np.sort(rng.random(12)), np.linspace(-0.2, 1.2, 50)
    for k in (1, 2, 3):
        p = np.poly1d(rng.random(k + 1))
        assert bspline.interpolate(x, p(x), q, k) == pytest.approx(p(q), abs=1e-10)
        assert bspline.interpolate(x, np.sin(9 * x), x, k) == pytest.approx(np.sin(9 * x))
    with pytest.raises(ValueError):
        bspline.fit([1.0], [2.0], 3)


def test_sinc_of_a_band_limited_image():
    r, c = np.mgrid[0:60, 0:60]
    image = np.sin(r * 0.4) + np.cos(c * 0.3)
    rows, cols = 10 + np.random.default_rng(1).random((2, 200)) * 40
    assert np.abs(sinc.resample(image, rows, cols) - np.sin(rows * 0.4) - np.cos(cols * 0.3)).max() < 5e-3
    assert np.isnan(sinc.resample(image, [3.0, 58.0], [30.0, 30.0])).all()


def test_pixels_to_ground_and_back_with_correction_and_terrain():
    m, rng = imagery.model(), np.random.default_rng(2)
    x, y = rng.random((2, 300)) * np.array([[299], [399]])
    for c in (None, np.array([[1e-8, 0, 0], [0, 1e-8, 0], [1e-6, -2e-6, 0]])):
        lon, lat, alt = pushbroom.to_ground(m, x, y, 700.0, c)
        assert np.abs(alt - 700).max() < 0.05
        a, b = pushbroom.to_pixel(m, lon, lat, alt, c)
        assert np.abs(a - x).max() < 1e-4 and np.abs(b - y).max() < 1e-4
    lon, lat, alt = pushbroom.to_ground(m, x, y, 0.0, None, lambda lo, la: 100 + 2000 * (la - 41))
    assert np.abs(alt - (100 + 2000 * (lat - 41))).max() < 0.1
    assert len(pushbroom.footprint(m)) == 5 and np.isnan(pushbroom.to_pixel(m, [np.nan], [41.0], [0.0])[0]).all()


def test_model_tables(spark):
    m = imagery.model(40, 30)
    lines, cols = sensors.tables(spark, "a", m)
    back = sensors.sensor(lines, cols, "a")
    for k in ("position", "to_orbit", "to_earth", "look", "velocity"):
        assert np.allclose(getattr(back, k), getattr(m, k))


def control(spark, m, c=None, n=40):
    """Points of a scene as its model with a correction sees them."""
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.random(n) * 299), np.floor(rng.random(n) * 399)
    h = rng.random(n) * 500
    lon, lat, alt = pushbroom.to_ground(m, x, y, h, c)
    e, q = geodesy.to_utm(lon, lat, 36, True)
    rows = [(f"g{i}", *map(float, v), 1.0, 32636) for i, v in enumerate(zip(lon, lat, alt, x, y, e, q))]
    return spark.createDataFrame(rows, "gcp_id string, lon double, lat double, alt double, xPix double, yPix double, x_map double, y_map double, weight double, epsg int")


def test_refinement_finds_a_correction(spark):
    m, c = imagery.model(), np.array([[1e-8, -2e-8, 0], [3e-8, 1e-8, 0], [2e-6, -1e-6, 1e-7]])
    points = control(spark, m, c)
    lines, cols = sensors.tables(spark, "s", m)
    named = points.withColumns({"model": F.lit("s"), "xpix": F.col("xPix"), "ypix": F.col("yPix")}).select("model", "gcp_id", "lon", "lat", "alt", "weight", F.col("xPix").alias("xpix"), F.col("yPix").alias("ypix"))
    got = np.array(sensors.refinement(named, lines, cols).first().correction).reshape(3, 3)
    rows = points.toPandas()
    for fit, good in ((got, True), (np.zeros((3, 3)), False)):
        a, b = pushbroom.to_pixel(m, rows.lon, rows.lat, rows.alt, fit)
        assert (np.hypot(a - rows.xPix, b - rows.yPix).max() < 0.2) == good
    best, moved, report = gcps.refine(points, lines, cols, "s", lambda g, k, loop: gcps.rsm_shifts(g, m, k, loop), 0.0, loops=2)
    assert report.count() == 2 and moved.count() == 40
    a, b = pushbroom.to_pixel(m, rows.lon, rows.lat, rows.alt, best)
    assert np.hypot(a - rows.xPix, b - rows.yPix).max() < 0.2


def test_grids(spark):
    g = ortho.map_grid(ortho.rfm_ground(MODEL), 6000, 6000, 30.0)
    assert g.epsg == 32636 and g.left % 30 == 0 and g.top % 30 == 0
    assert g.transform == (g.left, 30.0, 0.0, g.top, 0.0, -30.0) and abs(g.left - 273570) < 1000 and abs(g.top - 4568250) < 1000  # the published corner lies on terrain
    assert ortho.snapped(10.0, 99.0, 55.0, 31.0, 10.0) == (10.0, 90.0, 50.0, 40.0)
    x0, dx, rx, y0, ry, dy = ortho.rfm_geotransform(MODEL, 6000, 6000)
    lon, lat = ortho.rfm_ground(MODEL)(np.array([3000.0]), np.array([3000.0]))
    assert x0 + 3000 * dx + 3000 * rx == pytest.approx(lon[0], abs=2e-2) and y0 + 3000 * ry + 3000 * dy == pytest.approx(lat[0], abs=2e-2)
    assert len(ortho.rfm_footprint(MODEL, 6000, 6000)) == 5 and '"Polygon"' in ortho.footprint_json("a", ortho.rfm_footprint(MODEL, 10, 10))
    low, high = ortho.altitude_range(MODEL)
    assert low < MODEL.scalars["HEIGHT_OFF"] < high


@pytest.mark.parametrize("method", ["bilinear", "sinc"])
def test_ortho_of_a_rigorous_model(spark, method):
    """An image of a plane in map coordinates comes back as that plane."""
    m = imagery.model(120, 90)
    r, c = np.mgrid[0:120, 0:90]
    lon, lat, _ = pushbroom.to_ground(m, c.ravel(), r.ravel(), 0.0)
    e, n = geodesy.to_utm(lon, lat, 36, True)
    raw = spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), ((e - e.min()) / 1e3 + (n - n.min()) / 1e3).tolist())), "row int, col int, value double")
    g, out = ortho.ortho_rsm(spark, raw, m, method=method, res=200.0)
    got = out.filter("value IS NOT NULL").toPandas()
    want = (g.left + (got.col + 0.5) * g.res - e.min()) / 1e3 + (g.top - (got.row + 0.5) * g.res - n.min()) / 1e3
    assert len(got) > 50 and np.abs(got.value - want).max() < (1e-3 if method == "bilinear" else 0.2)


def test_elevation_and_reprojection(spark):
    dem = spark.range(60 * 50).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col")).withColumn("value", F.col("row") * 2.0 + F.col("col"))
    at = spark.createDataFrame([(1, 30.105, 40.895), (2, 10.0, 10.0)], "id int, lon double, lat double")
    got = {r.id: r.height for r in ortho.with_elevation(at, dem, (30.0, 0.01, 0.0, 41.0, 0.0, -0.01), 4326, ["id"]).collect()}
    assert got[1] == pytest.approx(10 * 2 + 10) and got[2] is None
    mean = {r.id: r.height for r in ortho.with_elevation(at, dem, (30.0, 0.01, 0.0, 41.0, 0.0, -0.01), 4326, ["id"], "nearest", mean=True).collect()}
    assert mean[1] == mean[2] == 30.0
    east, north = geodesy.to_utm(np.array([30.2]), np.array([40.8]), 36, True)
    grid = ortho.Grid(float(east[0]), float(north[0]), 500.0, 8, 6, 32636)
    out = ortho.reproject(spark, dem, (30.0, 0.01, 0.0, 41.0, 0.0, -0.01), 4326, grid)
    lon, lat = geodesy.from_utm(grid.left + 250, grid.top - 250, 36, True)
    first = out.filter("row = 0 AND col = 0").first().value
    assert out.count() == 48 and first == np.floor((41 - lat) / 0.01) * 2 + np.floor((lon - 30) / 0.01)


def test_displacement_needs_every_value(spark):
    names = displacement.NAMES
    row = {"row": 1, "col": 2, "x": 330000.0, "y": 4560000.0} | {f"{k}_{n}": 0.0 for n in names[1:] for k in ("ew", "ns")} | {f"h_{n}": 100.0 for n in names} | {f"line_{n}": 50.0 for n in names}
    df = spark.createDataFrame([row, row | {"row": 2, "line_pre": None}, row | {"row": 3, "ew_post1": 2.0, "ew_post2": 2.0}], "row int, col int, x double, y double, " + ", ".join(f"{k}_{n} double" for n in names[1:] for k in ("ew", "ns")) + ", " + ", ".join(f"{k}_{n} double" for k in ("h", "line") for n in names))
    got = {r.row: r for r in displacement.displacement(df, [imagery.model(tilt=v).position for v in (0.0, 0.3, -0.2, 0.25)], 32636).collect()}
    assert got[1].ew == pytest.approx(0, abs=1e-3) and got[2].ew is None and got[3].ew == pytest.approx(2.0, abs=1e-3)
    back = displacement.displacement(df.filter("row = 3"), [imagery.model(tilt=v).position for v in (0.0, 0.3, -0.2, 0.25)], 32636, inverted=True).first()
    assert back.ew == pytest.approx(-2.0, abs=1e-3)


def texture(n=160, seed=4):
    f = np.fft.fftfreq(n)
    fx, fy = np.meshgrid(f, f)
    return np.fft.ifft2(np.fft.fft2(np.random.default_rng(seed).normal(size=(n, n))) * np.exp(-40 * (fx * fx + fy * fy))).real


def frame(spark, image, r0=0, c0=0):
    r, c = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
    return spark.createDataFrame(list(zip((r.ravel() + r0).tolist(), (c.ravel() + c0).tolist(), image.ravel().tolist())), "row int, col int, value double")


@pytest.mark.parametrize("method,window", [("frequency", 32), ("spatial", 16)])
def test_correlation_of_georeferenced_images(spark, method, window):
    """The target lies 5 columns east and 3 rows south in the map and moved by (2, 1) pixels more."""
    image = texture()
    base, target = frame(spark, image[20:120, 20:120]), frame(spark, image[22:110, 23:115])
    at = lambda w, h, c, r: correlation.Image(w, h, 500000.0 + c * 2, 4600000.0 - r * 2, 2.0, 2.0, 32636)
    d, out = correlation.run(spark, base, at(100, 100, 0, 0), target, at(92, 88, 5, 3), correlation.Params(method, window, 8, 6, gridded=True))
    got = out.toPandas()
    assert d["map_mode"] and (d["rows"], d["cols"]) == (got.row.max() + 1, got.col.max() + 1) and len(got) == d["rows"] * d["cols"]
    assert got.ew.median() == pytest.approx(2 * 2.0, abs=0.2) and got.ns.median() == pytest.approx(-1 * 2.0, abs=0.2)
    half = (6 if method == "spatial" else 0) + window / 2
    assert (d["transform"][0] - 2 * half) % 2 == 0 and d["transform"][0] % 16 == 0 and d["transform"][1] == 16.0
    whole = correlation.with_borders(out, d["rows"] + 3, d["cols"] + 2, (1, 2))
    assert whole.count() == (d["rows"] + 3) * (d["cols"] + 2)


def test_faults_and_pixel_mode(spark):
    a, b = correlation.Image(64, 64), correlation.Image(80, 50, epsg=32636)
    d = correlation.plan(spark, a, b, correlation.Params("frequency", 16, 8))
    assert not d["map_mode"] and (d["width"], d["height"]) == (64, 50) and d["transform"] == (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    with pytest.raises(ValueError, match="power of two"):
        correlation.plan(spark, a, a, correlation.Params("frequency", 24, 8))
    far = correlation.Image(64, 64, 1e6, 0.0, 1.0, 1.0, 32636)
    with pytest.raises(ValueError, match="overlap"):
        correlation.plan(spark, correlation.Image(64, 64, 0.0, 0.0, 1.0, 1.0, 32636), far, correlation.Params("frequency", 16, 8))


def test_tie_points_by_correlation(spark):
    image = texture(seed=6)
    got = correlation.tie_points(frame(spark, image[10:140, 10:140]), frame(spark, image[12:142, 7:137])).toPandas()
    assert len(got) > 4 and (got.raw_x - got.ref_x).median() == pytest.approx(3, abs=0.1) and (got.raw_y - got.ref_y).median() == pytest.approx(-2, abs=0.1)


def orbit_xml(t):
    p = imagery.model().position
    pts = "".join(f"<Point><Location><X>{x}</X><Y>{y}</Y><Z>{z}</Z></Location><Velocity><X>1</X><Y>2</Y><Z>7000</Z></Velocity><TIME>{s}</TIME></Point>" for s, (x, y, z) in zip(t, p[:: max(1, len(p) // len(t))]))
    return f"<Points>{pts}</Points>"


def stamp(s):
    return f"2001-02-03T04:05:{s:09.6f}Z"


def test_dimap_of_the_older_satellites():
    times = [stamp(10 + i) for i in range(12)]
    angles = lambda tag, n, flag: "".join(f"<{tag}><TIME>{stamp(14 + i * 0.5)}</TIME><YAW>0.0</YAW><PITCH>1e-5</PITCH><ROLL>-1e-5</ROLL><OUT_OF_RANGE>{flag if i == 1 else 'N'}</OUT_OF_RANGE></{tag}>" for i in range(n))
    text = f"""<Dimap_Document><Dataset_Sources><Source_Information><Scene_Source><SUN_AZIMUTH>120.5</SUN_AZIMUTH><SUN_ELEVATION>40</SUN_ELEVATION><MISSION_INDEX>2</MISSION_INDEX><INSTRUMENT_INDEX>1</INSTRUMENT_INDEX>
    <INSTRUMENT>HRV</INSTRUMENT><SENSOR_CODE>P</SENSOR_CODE><INCIDENCE_ANGLE>3.5</INCIDENCE_ANGLE><IMAGING_DATE>2001-02-03</IMAGING_DATE><IMAGING_TIME>04:05:15</IMAGING_TIME></Scene_Source></Source_Information></Dataset_Sources>
    <Raster_Dimensions><NCOLS>60</NCOLS><NROWS>100</NROWS><NBANDS>1</NBANDS></Raster_Dimensions><Data_Strip><Sensor_Configuration><Time_Stamp><LINE_PERIOD>0.0015</LINE_PERIOD><SCENE_CENTER_TIME>2001-02-03T04:05:15.5</SCENE_CENTER_TIME><SCENE_CENTER_LINE>50</SCENE_CENTER_LINE></Time_Stamp>
    <Instrument_Look_Angles_List><Look_Angles_List><Look_Angles><PSI_X>0.01</PSI_X><PSI_Y>0.02</PSI_Y></Look_Angles><Look_Angles><PSI_X>0.01</PSI_X><PSI_Y>-0.02</PSI_Y></Look_Angles></Look_Angles_List></Instrument_Look_Angles_List></Sensor_Configuration>
    <Ephemeris>{orbit_xml(times)}</Ephemeris><Satellite_Attitudes><Raw_Attitudes><Aocs_Attitude><Angles_List>{angles('Angles', 2, 'N')}</Angles_List><Angular_Speeds_List>{angles('Angular_Speeds', 6, 'Y')}</Angular_Speeds_List></Aocs_Attitude></Raw_Attitudes></Satellite_Attitudes></Data_Strip></Dimap_Document>"""
    d = metadata.spot15(text)
    assert (d["cols"], d["lines"], d["mission"], d["mirror_step"], d["centre_line"]) == (60, 100, 2, 0, 50) and d["position"].shape == (12, 3) and d["rate_bad"].tolist() == [False, True, False, False, False, False]
    m = pushbroom.build_angle_sensor(d | {"ccd": np.zeros((60, 3))})
    assert m.shape == (100, 60) and np.allclose(np.linalg.norm(m.look, axis=1), 1) and np.allclose(np.einsum("nij,nkj->nik", m.to_orbit, m.to_orbit), np.eye(3), atol=1e-9)
    with pytest.raises(ValueError, match="orbit"):
        pushbroom.build_angle_sensor(d | {"centre_time": d["centre_time"] + 100})
    assert metadata.seconds("2001-02-03T04:05:06.5Z") - metadata.seconds("2001-02-03T04:05:06") == 0.5


def test_dimap_of_the_newer_satellites():
    m, q = imagery.model(), np.array([0.0, 0.0, 0.0, 1.0])
    points = "".join(f"<Point><TIME>{stamp(10 + i)}</TIME><LOCATION_XYZ>{' '.join(map(str, p))}</LOCATION_XYZ><VELOCITY_XYZ>{' '.join(map(str, v))}</VELOCITY_XYZ></Point>" for i, (p, v) in enumerate(zip(m.position[::40], m.velocity[::40])))
    quats = "".join(f"<Quaternion><TIME>{stamp(10 + i)}</TIME><Q0>{q[3]}</Q0><Q1>{q[0]}</Q1><Q2>{q[1]}</Q2><Q3>{q[2]}</Q3></Quaternion>" for i in range(10))
    use = "".join(f"<{k}>{v}</{k}>" for k, v in {"SUN_AZIMUTH": 1, "SUN_ELEVATION": 2, "GSD_ACROSS_TRACK": 1.4, "GSD_ALONG_TRACK": 1.6, "TIME": 0, "SATELLITE_ALTITUDE": 7e5, "AZIMUTH_ANGLE": 3, "VIEWING_ANGLE": 4, "INCIDENCE_ANGLE": 5}.items())
    text = f"""<D><NCOLS>50</NCOLS><NROWS>80</NROWS><NBANDS>4</NBANDS><Use_Area>{use}</Use_Area><Refined_Model><Time><Time_Range><START>{stamp(12)}</START><END>{stamp(13)}</END></Time_Range><Time_Stamp><LINE_PERIOD>1500</LINE_PERIOD></Time_Stamp></Time><A><FOCAL_LENGTH>12.9</FOCAL_LENGTH></A>
    <G><Polynomial_Look_Angles><XLOS_0>0.001</XLOS_0><XLOS_1>1e-6</XLOS_1><YLOS_0>0.002</YLOS_0><YLOS_1>-1e-6</YLOS_1></Polynomial_Look_Angles></G><Ephemeris><Point_List>{points}</Point_List></Ephemeris><Attitudes><Quaternion_List>{quats}</Quaternion_List></Attitudes></Refined_Model></D>"""
    d = metadata.spot67(text)
    assert d["gsd"] == 1.5 and d["sun_azimuth"] == 1 and d["sun_elevation"] == 2 and d["line_period"] == 1500 / 1e6 and d["quaternion"].shape == (10, 4) and d["quaternion"][0].tolist() == [0, 0, 0, 1]
    s = pushbroom.build_quaternion_sensor(d)
    assert s.shape == (80, 50) and np.allclose(s.look[0], pushbroom.unit(np.array([-0.001, 0.002, -1.0])))
    u = pushbroom.direction(s, np.array([0.0]), np.array([3.0]))[0]
    assert u == pytest.approx(pushbroom.SWAP @ s.look[0])


IMD = """version = "R";\nBEGIN_GROUP = BAND_P\nEND_GROUP = BAND_P\nbandId = "P";\nimageDescriptor = "Basic1B";\nnumRows = 30;\nnumColumns = 20;\nsatId = "WV02";\nfirstLineTime = 2010-01-02T03:04:05.500000Z;\navgLineRate = 1000.0;\nscanDirection = "Reverse";\nmeanProductGSD = 0.5;\nmeanSunAz = 150.1;\nmeanSunEl = 45;\nmeanSatEl = 70;\nmeanSatAz = 33;\nmeanOffNadirViewAngle = 12;\n"""
GEO = "PD = 13000.0;\nqcs1 = 0.0;\nqcs2 = 0.0;\nqcs3 = 0.0;\nqcs4 = 1.0;\ndetOriginX = 1.0;\ndetOriginY = 40.0;\ndetPitch = 0.008;\n"


def test_digital_globe_text_and_xml(tmp_path):
    m = imagery.model()
    eph = [(i + 1, *m.position[i], *m.velocity[i], 0, 0, 0, 0, 0, 0) for i in range(5)]
    att = [(i + 1, 0.0, 0.0, 0.0, 1.0, *[0] * 10) for i in range(5)]
    listed = lambda name, rows: f"startTime = 2010-01-02T03:04:05.000000Z;\nnumPoints = 5;\ntimeInterval = 0.5;\n{name} = (\n" + ",\n".join("(" + ", ".join(map(str, r)) + ")" for r in reversed(rows)) + ");\n"
    for ext, text in {".IMD": IMD, ".EPH": listed("ephemList", eph), ".ATT": listed("attList", att), ".GEO": GEO}.items():
        (tmp_path / f"scene{ext}").write_text(text)
    d = metadata.read_scene(str(tmp_path / "scene.IMD"), "WV2")
    assert (d["cols"], d["lines"], d["forward"], d["platform"], d["sat_azimuth"], d["sun_azimuth"]) == (20, 30, False, "WV02", 33, 150.1) and np.allclose(d["position"], m.position[:5])
    tag = lambda k, v: f"<{k}>{v}</{k}>"
    imd = "".join(tag(k.upper(), metadata.entry(IMD, k)) for k in ("bandId", "imageDescriptor", "numRows", "numColumns", "satId", "firstLineTime", "avgLineRate", "scanDirection", "meanProductGSD", "meanSunAz", "meanSunEl", "meanSatEl", "meanSatAz", "meanOffNadirViewAngle"))
    part = lambda name, key, rows: tag(name, tag("STARTTIME", "2010-01-02T03:04:05.000000Z") + tag("TIMEINTERVAL", 0.5) + tag("NUMPOINTS", 5) + "".join(tag(key, " ".join(map(str, r))) for r in rows))
    geo = tag("GEO", "".join(tag(k.upper(), metadata.entry(GEO, k)) for k in ("PD", "qcs1", "qcs2", "qcs3", "qcs4", "detOriginX", "detOriginY", "detPitch")))
    (tmp_path / "scene.xml").write_text(tag("isd", tag("IMD", imd) + part("EPH", "EPHEMLIST", eph) + part("ATT", "ATTLIST", att) + geo))
    x = metadata.read_scene(str(tmp_path / "scene.xml"), "wv2")
    assert all(np.array_equal(d[k], x[k]) for k in d)
    s = metadata.build(str(tmp_path / "scene.xml"), "WV2")
    assert s.shape == (30, 20) and s.look[0] == pytest.approx(pushbroom.unit(np.array([40.0, 1.0, -13000.0])))
    with pytest.raises(ValueError, match="supported"):
        metadata.read_scene("a.xml", "Landsat")


def test_ccd_table(spark, tmp_path):
    (tmp_path / "ccd").write_text("1.0 2.0 3.0\n-1e-3 0 0.5\n")
    got = metadata.ccd_table(spark, str(tmp_path / "ccd")).orderBy("col").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 2.0, 3.0), (1, -0.001, 0.0, 0.5)]


WAVES = np.random.default_rng(8).normal(0, 1 / 55, (150, 2))


def surface(e, n):
    """A texture of the map: many waves of some hundred metres and more."""
    return sum(np.sin(e * a + n * b + 7 * i) for i, (a, b) in enumerate(WAVES))


def test_patches_find_points_that_are_off(spark):
    """Raw image and reference show one texture; points moved in the map are brought back by their patches."""
    m = imagery.model(300, 260)
    r, c = np.mgrid[0:300, 0:260]
    lon, lat, _ = pushbroom.to_ground(m, c.ravel(), r.ravel(), 0.0)
    e, n = geodesy.to_utm(lon, lat, 36, True)
    raw = spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), surface(e, n).tolist())), "row int, col int, value double")
    res, mid = 15.0, (float(e.mean()), float(n.mean()))
    left, top = mid[0] - 120 * res, mid[1] + 120 * res
    rr, cc = np.mgrid[0:240, 0:240]
    ref = spark.createDataFrame(list(zip(rr.ravel().tolist(), cc.ravel().tolist(), surface(left + (cc.ravel() + 0.5) * res, top - (rr.ravel() + 0.5) * res).tolist())), "row int, col int, value double")
    rows = []
    for i, (x, y) in enumerate(((0, 0), (300, -200), (9e5, 0))):
        lo, la = geodesy.from_utm(mid[0] + x, mid[1] + y, 36, True)
        rows.append((f"g{i}", float(lo), float(la), 0.0, mid[0] + x, mid[1] + y, 1.0, 32636))
    points = spark.createDataFrame(rows, "gcp_id string, lon double, lat double, alt double, x_map double, y_map double, weight double, epsg int")
    got = {r.gcp_id: r for r in gcps.patch_shifts(points, m, None, raw, ref, (left, res, 0.0, top, 0.0, -res), 32, res).collect()}
    assert abs(got["g0"].dx) < 0.1 and abs(got["g1"].dy) < 0.1 and got["g0"].snr > 0.5 and got["g2"].snr == 0
    # a correction that tilts the model shifts what the patches show
    off = np.array([[0, 0, 0], [0, 0, 0], [4e-5, 0, 0]])
    a, b = (np.array(pushbroom.to_ground(m, [130.0], [150.0], 0.0, k)[:2]).ravel() for k in (None, off))
    east = geodesy.to_utm(b[0], b[1], 36, True)[0] - geodesy.to_utm(a[0], a[1], 36, True)[0]
    moved = {r.gcp_id: r for r in gcps.patch_shifts(points, m, off, raw, ref, (left, res, 0.0, top, 0.0, -res), 32, res).collect()}
    assert moved["g0"].dx * res == pytest.approx(east, abs=4.0)
