import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rasterloom.functions import geodesy, rfm
from rasterloom.operators import correlate, pairs, series
from rasterloom.plans import catalogue
from rasterloom.sources.rpc import parse_rpc
from rasterloom.sources.text_tables import expand_list

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else round(float(v), 6) if isinstance(v, float) else v if not isinstance(v, list) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", catalogue.SQL)
def test_equals_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(str(v) for v in r)
    a, b = sorted(plain(got.select(*names).collect()), key=key), sorted(plain(cur.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-8, abs_tol=2e-6) for p, q in zip(x, y)), (x, y)


def test_published_model_values(spark):
    """Ground points that map to pixels (0, 0) and (1000, 500) of the sample scene."""
    df = spark.createDataFrame([(30.52895296, 41.24090926), (30.65688292, 41.16826844)], "lon double, lat double")
    c, l = rfm.ground_to_image(catalogue.MODEL, df.lon, df.lat)
    got = [tuple(r) for r in df.select(c.alias("c"), l.alias("l")).collect()]
    assert got[0] == pytest.approx((9.70195697e-06, 5.07104141e-06), abs=1e-10)
    assert got[1] == pytest.approx((999.999998, 500.000045), abs=5e-7)


def test_missing_key_is_an_error():
    with pytest.raises(ValueError):
        parse_rpc("LINE_OFF: 3")
    assert expand_list(" a, ,b*,") == ["a", "b*"]


@pytest.mark.parametrize("dx,dy", [(0.0, 0.0), (0.37, -0.21), (2.4, 1.6), (-3.25, 0.5)])
def test_kernels_recover_shifts(dx, dy):
    rng, n = np.random.default_rng(3), 128
    f = np.fft.fftfreq(n)
    fx, fy = np.meshgrid(f, f)
    spec = np.fft.fft2(rng.normal(size=(n, n))) * np.exp(-40 * (fx * fx + fy * fy))
    base, moved = np.fft.ifft2(spec).real, np.fft.ifft2(spec * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real
    got = correlate.phase_shift(base[32:96, 32:96], moved[32:96, 32:96])
    assert got[:2] == pytest.approx((dx, dy), abs=0.05) and got[2] > 0.9
    got = correlate.ncc(base[40:72, 40:72], moved[34:78, 34:78], 6)
    assert got[:2] == pytest.approx((dx, dy), abs=0.15) and got[2] > 0.9
    assert math.isnan(correlate.ncc(np.ones((4, 4)), np.ones((8, 8)), 2)[0])


def test_gram_and_full_rank_reconstruction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, row.tolist(), [1.0] * 5) for i, row in enumerate(x)], "id int, x array<double>, w array<double>")
    assert series.gram(df, 5) == pytest.approx(x.T @ x)
    v, s, chi, out = series.pcaim(df, 5, 5)
    assert s == pytest.approx(np.linalg.svd(x)[1]) and chi[-1] < 1e-12
    assert {r.id: r.y for r in out.collect()}[7] == pytest.approx(x[7].tolist())


def test_components_separate_sources(spark):
    rng = np.random.default_rng(2)
    s = rng.uniform(-1, 1, (3000, 2))
    x = s @ np.array([[1.0, 0.4, 0.2], [0.3, 1.0, -0.5]])
    _, out = series.ica(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>"), 3, 2)
    ic = np.array([r.ic for r in out.orderBy("id").collect()])
    c = np.abs(np.corrcoef(ic.T, s.T)[:2, 2:])
    assert (c.max(axis=1) > 0.98).all()


def test_boxes_that_touch_and_empty_tables(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 2.0, 1.0), (3, 5.0, 5.0, 6.0, 6.0)], "id int, minx double, miny double, maxx double, maxy double")
    got = pairs.overlapping(b, b, 0.3).filter("l_id < r_id").collect()
    assert [(r.l_id, r.r_id, r.overlap) for r in got] == [(1, 2, 0.0)]
    assert not pairs.overlapping(b.filter("false"), b, 0.3).collect()


def test_utm_is_its_own_inverse(spark):
    p = spark.range(200).select((F.col("id") * 1.7 - 170).alias("lon"), (F.col("id") * 0.8 - 79).alias("lat"))
    e, n = geodesy.to_utm(p.lon, p.lat, geodesy.utm_zone(p.lon), p.lat > 0)
    q = p.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = geodesy.from_utm(q.e, q.n, geodesy.utm_zone(q.lon), q.lat > 0)
    assert all(r[0] == pytest.approx(r[2], abs=1e-10) and r[1] == pytest.approx(r[3], abs=1e-10) for r in q.select("lon", "lat", lon, lat).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
