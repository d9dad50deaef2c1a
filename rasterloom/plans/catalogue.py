"""The raster operators bound to the driver's tables, each with SQL for the same rows.

The tables hold no rasters, so embeddings stand for one (row vec_id, column
the place in the vector), events for sampled sensors, and orders, suppliers
and customers for catalogues and coordinates. Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy, grid, rfm, vectors
from ..operators import correlate, pairs, raster, sequences, series, stats
from ..sources.rpc import parse_rpc, rpc_entries
from ..sources.sample_rpc import RPC_TEXT
from ..sources.text_tables import correlation_name, parse_tie_points, stem

MODEL = parse_rpc(RPC_TEXT)
CORRECTION = [1e-4, 2e-5, 3e-4, -2e-5, 1e-4, -4e-4, 0.0, 0.0, 1.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **cols) -> DataFrame:
    return df.withColumns({k: F.round(v, digits) for k, v in cols.items()})


# coordinates
LON, LAT, ALT = "(30.4e0 + (c_custkey % 100) / 100e0 * 0.9e0)", "(40.6e0 + (c_custkey % 77) / 77e0 * 0.6e0)", "(c_acctbal / 10e0)"
FAR_LON, FAR_LAT = "((c_custkey * 37 % 3600) / 10e0 - 180e0)", "((c_custkey * 53 % 1600) / 10e0 - 79.95e0)"


def points(spark, sf, lon=LON, lat=LAT) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", F.expr(lon).alias("lon"), F.expr(lat).alias("lat"), F.expr(ALT).alias("alt"))


def _poly(c) -> str:
    return " + ".join(f"({v!r}::DOUBLE)" + "*x" * i + "*y" * j + "*z" * k for v, (i, j, k) in zip(c, rfm.TERMS, strict=True))


_S = MODEL.scalars
NORMAL_SQL = f"""n AS (SELECT c_custkey, ({LAT} - {_S['LAT_OFF']}::DOUBLE) / {_S['LAT_SCALE']}::DOUBLE AS x, ({LON} - {_S['LONG_OFF']}::DOUBLE) / {_S['LONG_SCALE']}::DOUBLE AS y,
  ({ALT} - {_S['HEIGHT_OFF']}::DOUBLE) / {_S['HEIGHT_SCALE']}::DOUBLE AS z FROM customer),
q AS (SELECT c_custkey, ({_poly(MODEL.samp_num)}) / ({_poly(MODEL.samp_den)}) AS c, ({_poly(MODEL.line_num)}) / ({_poly(MODEL.line_den)}) AS l FROM n)"""
TO_PIXEL = f"round({{c}} * {_S['SAMP_SCALE']}::DOUBLE + {_S['SAMP_OFF']}::DOUBLE, 5) AS col, round({{l}} * {_S['LINE_SCALE']}::DOUBLE + {_S['LINE_OFF']}::DOUBLE, 5) AS line"


@query(f"WITH {NORMAL_SQL} SELECT c_custkey, {TO_PIXEL.format(c='c', l='l')} FROM q")
def rfm_g2i(spark, sf):
    p = points(spark, sf)
    col, line = rfm.ground_to_image(MODEL, p.lon, p.lat, p.alt)
    return p.select("c_custkey", F.round(col, 5).alias("col"), F.round(line, 5).alias("line"))


@query(f"WITH {NORMAL_SQL} SELECT c_custkey, {TO_PIXEL.format(c='(c + 1e-4*c + 2e-5*l + 3e-4)', l='(l - 2e-5*c + 1e-4*l - 4e-4)')} FROM q")
def rfm_correction(spark, sf):
    p = points(spark, sf)
    col, line = rfm.ground_to_image(MODEL, p.lon, p.lat, p.alt, CORRECTION)
    return p.select("c_custkey", F.round(col, 5).alias("col"), F.round(line, 5).alias("line"))


@query(f"SELECT c_custkey, round({LON}, 7) AS lon, round({LAT}, 7) AS lat FROM customer")
def rfm_i2g(spark, sf):
    """Back to the ground from the forward model's pixels: the points themselves."""
    p = points(spark, sf)
    col, line = rfm.ground_to_image(MODEL, p.lon, p.lat, p.alt)
    back = rfm.image_to_ground(p.select("c_custkey", "alt", col.alias("col"), line.alias("line")), MODEL, keep=("c_custkey",))
    return back.select("c_custkey", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query(f"SELECT c_custkey, CAST(floor(({FAR_LON} + 180) / 6) + 1 AS INT) AS zone, CAST((CASE WHEN {FAR_LAT} > 0 THEN 32600 ELSE 32700 END) + floor(({FAR_LON} + 180) / 6) + 1 AS INT) AS epsg FROM customer")
def utm_zone(spark, sf):
    p = points(spark, sf, FAR_LON, FAR_LAT)
    return p.select("c_custkey", geodesy.utm_zone(p.lon).alias("zone"), geodesy.utm_epsg(p.lon, p.lat).cast("int").alias("epsg"))


def _series(c, kind, var="xi", other="eta"):
    return "".join(f" + ({a!r}::DOUBLE) * {kind[0]}({2 * j} * {var}) * {kind[1]}({2 * j} * {other})" for j, a in enumerate(c, 1))


UTM_SQL = f"""WITH p AS (SELECT c_custkey, {FAR_LON} AS lon, {FAR_LAT} AS lat FROM customer),
z AS (SELECT *, floor((lon + 180) / 6) + 1 AS zone FROM p),
s AS (SELECT *, radians(lon - (zone * 6 - 183)) AS d, sinh(atanh(sin(radians(lat))) - {geodesy.E!r}::DOUBLE * atanh({geodesy.E!r}::DOUBLE * sin(radians(lat)))) AS tt FROM z),
u AS (SELECT *, atan2(tt, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + tt * tt)) AS eta FROM s)
SELECT c_custkey, round({geodesy.K0 * geodesy.RADIUS!r}::DOUBLE * (eta{_series(geodesy.ALPHA, ('cos', 'sinh'))}) + 500000, 4) AS east,
  round({geodesy.K0 * geodesy.RADIUS!r}::DOUBLE * (xi{_series(geodesy.ALPHA, ('sin', 'cosh'))}) + CASE WHEN lat > 0 THEN 0 ELSE 10000000 END, 4) AS north FROM u"""


@query(UTM_SQL)
def utm_project(spark, sf):
    p = points(spark, sf, FAR_LON, FAR_LAT)
    e, n = geodesy.to_utm(p.lon, p.lat, geodesy.utm_zone(p.lon), p.lat > 0)
    return p.select("c_custkey", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"))


@query(f"SELECT c_custkey, round({FAR_LON}, 8) AS lon, round({FAR_LAT}, 8) AS lat FROM customer")
def utm_inverse(spark, sf):
    p = points(spark, sf, FAR_LON, FAR_LAT)
    e, n = geodesy.to_utm(p.lon, p.lat, geodesy.utm_zone(p.lon), p.lat > 0)
    q = p.select("c_custkey", e.alias("e"), n.alias("n"), geodesy.utm_zone(p.lon).alias("z"), (p.lat > 0).alias("up"))
    lon, lat = geodesy.from_utm(q.e, q.n, q.z, q.up)
    return q.select("c_custkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


ECEF_SQL = f"""WITH p AS (SELECT c_custkey, radians({FAR_LON}) AS g, radians({FAR_LAT}) AS f, {ALT} AS h FROM customer),
q AS (SELECT *, {geodesy.A}::DOUBLE / sqrt(1 - {geodesy.E2!r}::DOUBLE * sin(f) * sin(f)) AS n FROM p)
SELECT c_custkey, round((n + h) * cos(f) * cos(g), 4) AS x, round((n + h) * cos(f) * sin(g), 4) AS y, round((n * {1 - geodesy.E2!r}::DOUBLE + h) * sin(f), 4) AS z FROM q"""


@query(ECEF_SQL)
def geodetic_to_ecef(spark, sf):
    p = points(spark, sf, FAR_LON, FAR_LAT)
    return p.select("c_custkey", *[F.round(c, 4).alias(n) for c, n in zip(geodesy.to_ecef(p.lon, p.lat, p.alt), "xyz", strict=True)])


@query(f"SELECT c_custkey, round({FAR_LON}, 8) AS lon, round({FAR_LAT}, 8) AS lat, round({ALT}, 4) AS alt FROM customer")
def ecef_to_geodetic(spark, sf):
    p = points(spark, sf, FAR_LON, FAR_LAT)
    q = p.select("c_custkey", *[c.alias(n) for c, n in zip(geodesy.to_ecef(p.lon, p.lat, p.alt), "xyz", strict=True)])
    lon, lat, alt = geodesy.from_ecef(q.x, q.y, q.z)
    return q.select("c_custkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"), F.round(alt, 4).alias("alt"))


@query("SELECT s_suppkey, round((298475e0 + s_acctbal * 10 - 298475e0) / 10e0, 6) AS col, round((4550925e0 - s_suppkey * 25 - 4550925e0) / -10e0, 6) AS line, round((s_suppkey + 0.5e0) * 10 + 298475, 6) AS x_map, round((s_nationkey + 0.5e0) * -10 + 4550925, 6) AS y_map FROM supplier")
def map_pixel(spark, sf):
    s = t(spark, sf, "supplier")
    c, r = grid.map_to_pixel(F.lit(298475.0) + s.s_acctbal * 10, F.lit(4550925.0) - s.s_suppkey * 25, 298475.0, 10.0, 4550925.0, -10.0)
    x, y = grid.pixel_to_map(s.s_suppkey, s.s_nationkey, 298475.0, 10.0, 4550925.0, -10.0)
    return s.select("s_suppkey", F.round(c, 6).alias("col"), F.round(r, 6).alias("line"), F.round(x, 6).alias("x_map"), F.round(y, 6).alias("y_map"))


_M = "(({v} % p_size) + p_size) % p_size"
_UP = "CASE WHEN {m} < p_size / 1e5 OR p_size - {m} < p_size / 1e5 THEN {v} ELSE {v} - {m} + p_size END"
_DOWN = "CASE WHEN {m} < p_size / 1e5 OR p_size - {m} < p_size / 1e5 THEN {v} ELSE {v} - {m} END"


def _snap(form, v):
    return form.format(v=v, m="(" + _M.format(v=v) + ")")


@query(f"SELECT p_partkey, round({_snap(_UP, 'p_retailprice')}, 6) AS ul_x, round({_snap(_DOWN, '(p_retailprice * 3)')}, 6) AS ul_y, round({_snap(_DOWN, '(p_retailprice * 2)')}, 6) AS br_x, round({_snap(_UP, '(0 - p_retailprice)')}, 6) AS br_y FROM part")
def grid_snap(spark, sf):
    p = t(spark, sf, "part")
    got = grid.snap_inward(p.p_retailprice, p.p_retailprice * 3, p.p_retailprice * 2, 0 - p.p_retailprice, p.p_size.cast("double"))
    return p.select("p_partkey", *[F.round(c, 6).alias(n) for c, n in zip(got, ("ul_x", "ul_y", "br_x", "br_y"), strict=True)])


@query("WITH m AS (SELECT p_partkey, p_retailprice, p_size, ((p_retailprice - 1500) % p_size + p_size) % p_size AS r FROM part) SELECT p_partkey, round(CASE WHEN abs(r) < 1e-5 OR abs(p_size - r) < 1e-5 THEN 0 ELSE r END, 6) AS rest, abs(p_retailprice / (p_retailprice + p_size / 50e0) - 1) <= 1e-3 AND abs(p_size / (p_size + 0e0) - 1) <= 1e-3 AS same_gsd FROM m")
def floor_mod_gsd(spark, sf):
    p = t(spark, sf, "part")
    size = p.p_size.cast("double")
    return p.select("p_partkey", F.round(grid.floor_mod(p.p_retailprice - 1500, size), 6).alias("rest"), grid.same_gsd(p.p_retailprice, size, p.p_retailprice + size / 50, size).alias("same_gsd"))


def elements(spark, sf, n: int) -> DataFrame:
    return t(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


E_SQL = "e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(12)) + " FROM embeddings)"


@query(f"WITH {E_SQL}, n AS (SELECT vec_id, e0/d AS w, e1/d AS x, e2/d AS y, e3/d AS z FROM (SELECT *, sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS d FROM e)) SELECT vec_id, round(1-2*(y*y+z*z),6) AS m0, round(2*(x*y-z*w),6) AS m1, round(2*(x*z+y*w),6) AS m2, round(2*(x*y+z*w),6) AS m3, round(1-2*(x*x+z*z),6) AS m4, round(2*(y*z-x*w),6) AS m5, round(2*(x*z-y*w),6) AS m6, round(2*(y*z+x*w),6) AS m7, round(1-2*(x*x+y*y),6) AS m8 FROM n")
def quat_to_matrix(spark, sf):
    e = elements(spark, sf, 4)
    return e.select("vec_id", *[F.round(c, 6).alias(f"m{i}") for i, c in enumerate(vectors.quaternion_matrix(e.e0, e.e1, e.e2, e.e3))])


@query(f"WITH {E_SQL}, a AS (SELECT vec_id, sin(e0) so, cos(e0) co, sin(e1) sp, cos(e1) cp, sin(e2) sk, cos(e2) ck FROM e) SELECT vec_id, round(cp*ck,6) AS m0, round(-cp*sk,6) AS m1, round(sp,6) AS m2, round(co*sk+so*sp*ck,6) AS m3, round(co*ck-so*sp*sk,6) AS m4, round(-so*cp,6) AS m5, round(so*sk-co*sp*ck,6) AS m6, round(so*ck+co*sp*sk,6) AS m7, round(co*cp,6) AS m8 FROM a")
def rotation_opk(spark, sf):
    e = elements(spark, sf, 3)
    return e.select("vec_id", *[F.round(c, 6).alias(f"m{i}") for i, c in enumerate(vectors.opk_matrix(e.e0, e.e1, e.e2))])


FRAME_SQL = f"""WITH {E_SQL}, z AS (SELECT *, e0/n AS z0, e1/n AS z1, e2/n AS z2 FROM (SELECT *, sqrt(e0*e0+e1*e1+e2*e2) AS n FROM e)),
c AS (SELECT *, e4*z2-e5*z1 AS c0, e5*z0-e3*z2 AS c1, e3*z1-e4*z0 AS c2 FROM z),
x AS (SELECT *, c0/m AS x0, c1/m AS x1, c2/m AS x2 FROM (SELECT *, sqrt(c0*c0+c1*c1+c2*c2) AS m FROM c))
SELECT vec_id, round(x0,6) AS x0, round(x1,6) AS x1, round(x2,6) AS x2, round(z1*x2-z2*x1,6) AS y0, round(z2*x0-z0*x2,6) AS y1, round(z0*x1-z1*x0,6) AS y2, round(z0,6) AS z0, round(z1,6) AS z1, round(z2,6) AS z2 FROM x"""


@query(FRAME_SQL)
def orbital_frame(spark, sf):
    e = elements(spark, sf, 6)
    got = vectors.orbital_frame((e.e0, e.e1, e.e2), (e.e3, e.e4, e.e5))
    return e.select("vec_id", *[F.round(c, 6).alias(f"{a}{i}") for a, v in zip("xyz", got, strict=True) for i, c in enumerate(v)])


TRI_SQL = f"""WITH {E_SQL}, s AS (SELECT *, e3*e3+e4*e4+e5*e5 AS a, e3*e9+e4*e10+e5*e11 AS b, e9*e9+e10*e10+e11*e11 AS c, e3*(e6-e0)+e4*(e7-e1)+e5*(e8-e2) AS u, e9*(e6-e0)+e10*(e7-e1)+e11*(e8-e2) AS v FROM e),
k AS (SELECT *, (c*u-b*v)/(a*c-b*b) AS l, (b*u-a*v)/(a*c-b*b) AS m FROM s),
q AS (SELECT vec_id, e0+l*e3 AS p0, e1+l*e4 AS p1, e2+l*e5 AS p2, e6+m*e9 AS q0, e7+m*e10 AS q1, e8+m*e11 AS q2 FROM k)
SELECT vec_id, round((p0+q0)/2,6) AS x, round((p1+q1)/2,6) AS y, round((p2+q2)/2,6) AS z, round(sqrt((q0-p0)*(q0-p0)+(q1-p1)*(q1-p1)+(q2-p2)*(q2-p2)),6) AS gap FROM q"""


@query(TRI_SQL)
def triangulate(spark, sf):
    e = elements(spark, sf, 12)
    mid, gap = vectors.triangulate((e.e0, e.e1, e.e2), (e.e3, e.e4, e.e5), (e.e6, e.e7, e.e8), (e.e9, e.e10, e.e11))
    return e.select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip((*mid, gap), ("x", "y", "z", "gap"), strict=True)])


@query(f"""WITH p AS (SELECT c_custkey, 7000000e0 AS s0, c_acctbal AS s1, -c_acctbal AS s2, -1e0 AS u0, (c_custkey % 90) / 300e0 AS u1, (c_custkey % 70) / 300e0 AS u2, ({vectors.RAY_A}+{ALT})*({vectors.RAY_A}+{ALT}) AS a, ({vectors.RAY_B}+{ALT})*({vectors.RAY_B}+{ALT}) AS b FROM customer),
q AS (SELECT *, (u0*u0+u1*u1)/a+u2*u2/b AS al, 2*((s0*u0+s1*u1)/a+s2*u2/b) AS be, (s0*s0+s1*s1)/a+s2*s2/b-1 AS ga FROM p),
m AS (SELECT *, CASE WHEN be*be-4*al*ga >= 0 THEN (-be-sqrt(greatest(be*be-4*al*ga, 0)))/(2*al) END AS m FROM q)
SELECT c_custkey, round(s0+m*u0,3) AS x, round(s1+m*u1,3) AS y, round(s2+m*u2,3) AS z FROM m""")
def ray_ellipsoid(spark, sf):
    c = t(spark, sf, "customer")
    p = c.select("c_custkey", F.lit(7e6).alias("s0"), c.c_acctbal.alias("s1"), (-c.c_acctbal).alias("s2"), F.lit(-1.0).alias("u0"), ((c.c_custkey % 90) / 300).alias("u1"), ((c.c_custkey % 70) / 300).alias("u2"), F.expr(ALT).alias("h"))
    got = vectors.ray_ellipsoid((p.s0, p.s1, p.s2), (p.u0, p.u1, p.u2), p.h)
    return p.select("c_custkey", *[F.round(v, 3).alias(n) for v, n in zip(got, "xyz", strict=True)])


@query("SELECT event_id, date_diff('microsecond', TIMESTAMP '1950-01-01', ts) AS us FROM events")
def epoch1950_micros(spark, sf):
    return t(spark, sf, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1950-01-01 00:00:00', ts)").alias("us"))


# statistics
@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
SELECT e.event_type, count(value) AS n, round(avg(value),6) AS mu, round(stddev_pop(value),6) AS sigma, round(sqrt(avg(nullif(value*value,0))),6) AS rmse, round(min(value),6) AS min_v, round(max(value),6) AS max_v, round(median(value),6) AS median_v, round(median(abs(value-m)),6) AS mad, round(median(abs(value-m))*1.4826e0,6) AS nmad,
round(avg(value)+stddev_pop(value)*0.994458e0,6) AS ce68, round(avg(value)+stddev_pop(value)*1.644854e0,6) AS ce90, round(avg(value)+stddev_pop(value)*1.959964e0,6) AS ce95, round(avg(value)+stddev_pop(value)*2.575829e0,6) AS ce99 FROM events e JOIN m USING (event_type) WHERE value IS NOT NULL GROUP BY e.event_type""")
def robust_stats(spark, sf):
    out = stats.robust_stats(t(spark, sf, "events"), "value", ["event_type"])
    return out.select(*[F.round(c, 6).alias(c) if c not in ("event_type", "n") else c for c in out.columns])


REPORT_SQL = "SELECT l_linenumber AS loop, round(avg(l_discount-0.05e0),6) AS mean_dx, round(avg(l_tax-0.04e0),6) AS mean_dy, round(sqrt(var_pop(l_discount-0.05e0)+var_pop(l_tax-0.04e0)),6) AS rmse, round(sqrt(avg(l_discount-0.05e0)*avg(l_discount-0.05e0)+avg(l_tax-0.04e0)*avg(l_tax-0.04e0)),6) AS avg_error, count(*) FILTER (l_quantity/50=0) AS n_zero, count(*) FILTER (l_quantity/50>0.9e0) AS n_good FROM lineitem GROUP BY 1"


def _loops(spark, sf):
    l = t(spark, sf, "lineitem")
    out = stats.loop_report(l.select("l_linenumber", (l.l_discount - 0.05).alias("dx"), (l.l_tax - 0.04).alias("dy"), (l.l_quantity / 50).alias("snr")), "l_linenumber", "dx", "dy", "snr")
    return rounded(out, **{c: F.col(c) for c in ("mean_dx", "mean_dy", "rmse", "avg_error")})


@query(REPORT_SQL)
def loop_report(spark, sf):
    return _loops(spark, sf)


@query(f"SELECT loop, avg_error FROM ({REPORT_SQL}) ORDER BY avg_error, loop LIMIT 1")
def best_loop(spark, sf):
    return stats.best_loop(_loops(spark, sf))


FIT_SQL = """WITH s AS (SELECT l_returnflag, q, x, y, o FROM (SELECT l_returnflag, (1-l_tax)*(1-l_tax) AS q, l_quantity AS x, l_extendedprice/1e4 AS y, l_discount AS o FROM lineitem)),
g AS (SELECT l_returnflag, sum(q*x*x) a, sum(q*x*y) b, sum(q*x) c, sum(q*y*y) d, sum(q*y) e, sum(q) f, sum(q*x*o) r, sum(q*y*o) s, sum(q*o) u FROM s GROUP BY 1),
k AS (SELECT *, a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c) AS det FROM g)
SELECT l_returnflag, round((r*(d*f-e*e)-b*(s*f-e*u)+c*(s*e-d*u))/det,8) AS a, round((a*(s*f-u*e)-r*(b*f-e*c)+c*(b*u-s*c))/det,8) AS b, round((a*(d*u-e*s)-b*(b*u-s*c)+r*(b*e-d*c))/det,8) AS c FROM k"""


@query(FIT_SQL)
def plane_fit(spark, sf):
    l = t(spark, sf, "lineitem")
    out = stats.plane_fit(l, l.l_quantity, l.l_extendedprice / 1e4, 1 - l.l_tax, l.l_discount, ["l_returnflag"])
    return rounded(out, 8, a=F.col("a"), b=F.col("b"), c=F.col("c"))


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity),4) AS slope, round(regr_intercept(l_extendedprice, l_quantity),4) AS base, round(regr_r2(l_extendedprice, l_quantity),6) AS r2 FROM lineitem GROUP BY 1")
def line_fit(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("base"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query()
def robust_affine(spark, sf):
    l = t(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1e4).alias("y"), F.col("l_discount").alias("o"))
    return spark.createDataFrame([tuple(round(v, 8) for v in stats.robust_plane_fit(l, "x", "y", "o"))], "a double, b double, c double")


@query("""WITH r AS (SELECT event_type, min(value) lo, max(value) hi FROM events GROUP BY 1)
SELECT event_type, CAST(coalesce(least(floor((value-lo)*10/nullif(hi-lo,0)),9),0) AS INT) AS bin, count(*) AS n FROM events JOIN r USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2""")
def histogram(spark, sf):
    return stats.histogram(t(spark, sf, "events"), "value", 10, ["event_type"])


@query("WITH p AS (SELECT event_type, quantile_cont(value,0.02) a, quantile_cont(value,0.98) b FROM events GROUP BY 1) SELECT event_id, round(greatest(least((value-a)/nullif(b-a,0),1),0),6) AS stretched FROM events JOIN p USING (event_type)")
def percentile_stretch(spark, sf):
    return stats.percentile_stretch(t(spark, sf, "events"), "value", ["event_type"]).select("event_id", F.round("stretched", 6).alias("stretched"))


@query("WITH p AS (SELECT event_type, min(value) a, max(value) b FROM events GROUP BY 1) SELECT event_id, round((value-a)/nullif(b-a,0),6) AS scaled FROM events JOIN p USING (event_type)")
def minmax_norm(spark, sf):
    return stats.minmax(t(spark, sf, "events"), "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount),9) AS mean_dx FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_stats(spark, sf):
    return t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("mean_dx"))


# sequences
def sensor(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D").alias("s"), "value", "event_type")


SENSOR = "e AS (SELECT event_id, user_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS s, value, event_type FROM events)"


@query(f"WITH {SENSOR} SELECT event_id, round(coalesce(lag(value) OVER w / 6 + value * (2e0/3e0) + lead(value) OVER w / 6, value),6) AS smooth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)")
def smooth3(spark, sf):
    return sequences.smooth3(sensor(spark, sf), "user_id", "s", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {SENSOR}, d AS (SELECT *, coalesce(value * (s - lag(s) OVER (PARTITION BY user_id ORDER BY s)), 0) AS step FROM e) SELECT event_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) + 5, 3) AS integral FROM d")
def integrate_rate(spark, sf):
    return sequences.integrate(sensor(spark, sf), "user_id", "s", "value", 5.0).select("event_id", F.round("integral", 3).alias("integral"))


INTERP_SQL = f"""WITH {SENSOR}, v AS (SELECT *, lead(s) OVER w AS t1, lead(value) OVER w AS v1 FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY s)),
g AS (SELECT * FROM v WHERE t1 IS NOT NULL), p AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'error'),
f AS (SELECT user_id, arg_min(struct_pack(t0 := s, v0 := value, t1 := t1, v1 := v1), s) AS b FROM g GROUP BY user_id),
j AS (SELECT p.user_id, p.s, CASE WHEN g.s IS NULL THEN f.b ELSE struct_pack(t0 := g.s, v0 := g.value, t1 := g.t1, v1 := g.v1) END AS b FROM p ASOF LEFT JOIN g ON p.user_id = g.user_id AND p.s >= g.s LEFT JOIN f ON p.user_id = f.user_id)
SELECT user_id, round(s,6) AS s, """


def _views(spark, sf):
    e = sensor(spark, sf)
    return e.filter("event_type = 'error'").select("user_id", "s"), e.filter("event_type = 'view'")


@query(INTERP_SQL + "round(b.t0,6) AS t0, round(b.v0,6) AS v0, round(b.t1,6) AS t1, round(b.v1,6) AS v1 FROM j")
def asof_bracket(spark, sf):
    b = sequences.bracket(*_views(spark, sf), "user_id", "s", "value")
    return b.select("user_id", *[F.round(c, 6).alias(c) for c in ("s", "t0", "v0", "t1", "v1")])


@query(INTERP_SQL + "round(b.v0 + (b.v1-b.v0)*(s-b.t0)/(b.t1-b.t0),4) AS value FROM j")
def linear_interp(spark, sf):
    return sequences.interpolate(*_views(spark, sf), "user_id", "s", "value").select("user_id", F.round("s", 6).alias("s"), F.round("value", 4).alias("value"))


@query(f"WITH {SENSOR}, d AS (SELECT *, CASE WHEN s < 864000 THEN -1 WHEN s > 1728000 THEN 1 ELSE 0 END AS side FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY CASE WHEN side < 0 THEN -s ELSE s END) AS r FROM d) SELECT event_id FROM r WHERE side = 0 OR r <= 4")
def trim4(spark, sf):
    return sequences.trim(sensor(spark, sf), "user_id", "s", 864000.0, 1728000.0).select("event_id")


@query(f"WITH {SENSOR}, d AS (SELECT user_id, lead(value) OVER (PARTITION BY user_id ORDER BY s) - value AS d FROM e WHERE event_type = 'purchase') SELECT user_id, CASE WHEN bool_and(d > -1e-9) AND bool_or(d > 1e-9) THEN 1 WHEN bool_and(d < 1e-9) AND bool_or(d < -1e-9) THEN -1 ELSE 0 END AS direction FROM d GROUP BY 1")
def monotonic(spark, sf):
    return sequences.direction(sensor(spark, sf).filter("event_type = 'purchase'"), "user_id", "s", "value")


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, greatest(count(*) OVER (PARTITION BY event_type) // 100, 1) AS k FROM events) SELECT event_id FROM r WHERE r % k = 0")
def every_kth(spark, sf):
    return sequences.every_kth(t(spark, sf, "events"), "event_type", ["event_id"], 100).select("event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_dedupe(spark, sf):
    return sequences.latest(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query(f"""WITH {SENSOR}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS a, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS b FROM e),
g AS (SELECT user_id, min(s) lo, max(s) hi, avg(value) FILTER (a <= 2) va, avg(value) FILTER (b <= 2) vb FROM r GROUP BY 1)
SELECT user_id, round(s,6) AS s, round(value,6) AS value FROM e UNION ALL SELECT user_id, 21600-0.001, round(va,6) FROM g WHERE lo > 21600 UNION ALL SELECT user_id, 2505600+0.001, round(vb,6) FROM g WHERE hi < 2505600""")
def pad_ends(spark, sf):
    out = sequences.pad_ends(sensor(spark, sf), "user_id", "s", "value", 21600.0, 2505600.0)
    return out.select("user_id", F.round("s", 6).alias("s"), F.round("value", 6).alias("value"))


@query(f"""WITH {SENSOR}, n AS (SELECT user_id, s, value, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i FROM e), m AS (SELECT * FROM n WHERE i <= 8),
x AS (SELECT user_id, avg(s) AS s FROM m GROUP BY 1 HAVING count(*) = 8),
l AS (SELECT x.user_id, x.s, p.value * product((x.s - q.s) / (p.s - q.s)) AS part FROM x JOIN m p ON x.user_id = p.user_id JOIN m q ON q.user_id = p.user_id AND q.i <> p.i GROUP BY x.user_id, x.s, p.i, p.value)
SELECT user_id, round(s,6) AS s, round(sum(part),4) AS value FROM l GROUP BY 1, 2""")
def lagrange8(spark, sf):
    e = sensor(spark, sf)
    m = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("s"))).filter("i <= 8")
    x = m.groupBy("user_id").agg(F.avg("s").alias("s"), F.count("*").alias("n")).filter("n = 8").drop("n")
    return sequences.lagrange(x, m, "user_id", "s", "value").select("user_id", F.round("s", 6).alias("s"), F.round("value", 4).alias("value"))


# catalogue joins
def boxes(spark, sf):
    s = t(spark, sf, "supplier")
    x, y = s.s_acctbal, (s.s_suppkey * 37 % 1000).cast("double")
    return s.select(s.s_suppkey.alias("id"), s.s_nationkey.alias("nation"), x.alias("minx"), y.alias("miny"), (x + 400 + s.s_nationkey * 10).alias("maxx"), (y + 60 + s.s_nationkey).alias("maxy"))


BOXES = "b AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS minx, (s_suppkey*37%1000)::DOUBLE AS miny, s_acctbal+400+s_nationkey*10 AS maxx, (s_suppkey*37%1000)::DOUBLE+60+s_nationkey AS maxy FROM supplier)"
OVERLAP_SQL = f"WITH {BOXES}, p AS (SELECT l.id AS pre, r.id AS post, least(l.maxx,r.maxx)-greatest(l.minx,r.minx) AS w, least(l.maxy,r.maxy)-greatest(l.miny,r.miny) AS h, least((l.maxx-l.minx)*(l.maxy-l.miny),(r.maxx-r.minx)*(r.maxy-r.miny)) AS a FROM b l, b r WHERE {{on}}) SELECT pre, post, round(100*w*h/a,6) AS overlap FROM p WHERE w >= 0 AND h >= 0"


@query(OVERLAP_SQL.format(on="l.nation < 12 AND r.nation >= 12") + " AND 100*w*h/a >= 20")
def bbox_overlap_pairs(spark, sf):
    b = boxes(spark, sf)
    return pairs.overlapping(b.filter("nation < 12"), b.filter("nation >= 12"), 500.0, 20.0).select(F.col("l_id").alias("pre"), F.col("r_id").alias("post"), F.round("overlap", 6).alias("overlap"))


@query(OVERLAP_SQL.format(on="l.id < r.id"))
def overlap_self_pairs(spark, sf):
    b = boxes(spark, sf)
    return pairs.overlapping(b, b, 500.0).filter("l_id < r_id").select(F.col("l_id").alias("pre"), F.col("r_id").alias("post"), grid.quick_round(F.col("overlap")).alias("overlap"))


@query("SELECT a.s_nationkey, a.s_suppkey AS s_suppkey_i, b.s_suppkey AS s_suppkey_j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_pairs(spark, sf):
    return pairs.self_pairs(t(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", ["s_suppkey"])


COMBO_SIDE = "SELECT a.s_nationkey, a.s_suppkey AS i0, b.s_suppkey AS i1, c.s_suppkey AS i2, d.s_suppkey AS i3 FROM {x} a JOIN {x} b ON a.s_nationkey=b.s_nationkey AND a.s_suppkey<>b.s_suppkey JOIN {y} c ON a.s_nationkey=c.s_nationkey JOIN {y} d ON a.s_nationkey=d.s_nationkey AND c.s_suppkey<d.s_suppkey"


@query("WITH a AS (SELECT * FROM supplier WHERE s_acctbal < 4500), z AS (SELECT * FROM supplier WHERE s_acctbal >= 4500) " + COMBO_SIDE.format(x="a", y="z") + " UNION ALL " + COMBO_SIDE.format(x="z", y="a"))
def three_d_combos(spark, sf):
    s = t(spark, sf, "supplier")
    return pairs.three_d_combinations(s.filter("s_acctbal < 4500"), s.filter("s_acctbal >= 4500"), "s_nationkey", "s_suppkey")


@query("SELECT o_orderkey AS base, o_custkey AS target FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def corr_jobs_full(spark, sf):
    return pairs.correlation_jobs(t(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderkey", "o_custkey", True)


@query("WITH a AS (SELECT c_nationkey AS k, c_custkey AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.i, b.i) AS INT) AS i, a.v AS base, b.v AS target FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i WHERE a.v IS NOT NULL AND b.v IS NOT NULL")
def serial_pairs(spark, sf):
    a, b = t(spark, sf, "customer").selectExpr("c_nationkey AS k", "c_custkey AS v"), t(spark, sf, "supplier").selectExpr("s_nationkey AS k", "s_suppkey AS v")
    return pairs.serial_pairs(a, b, ["k"], ["v"], "v").filter("base IS NOT NULL AND target IS NOT NULL")


@query("SELECT c_custkey, c_name, coalesce(o.p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def merge_update(spark, sf):
    u = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return pairs.merge_update(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), u, "c_custkey", ["c_acctbal"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def skip_existing(spark, sf):
    return pairs.missing(t(spark, sf, "customer"), t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("WITH a AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang <> 'en') SELECT line FROM a WHERE line NOT IN (SELECT line FROM b WHERE line IS NOT NULL)")
def line_anti_join(spark, sf):
    d = t(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return pairs.missing(d.filter("lang = 'en'"), d.filter("lang <> 'en'").select("line"), ["line"]).select("line")


# rasters
def pixels(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))


PX = "px AS (SELECT CAST(vec_id AS INT) AS row, CAST(i AS INT) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, unnest(range(0, 64)) AS r(i))"


@query(f"WITH {PX} SELECT row, col, round(value,6) AS value FROM px WHERE row BETWEEN 10 AND 40 AND col BETWEEN 3 AND 20")
def window_read(spark, sf):
    return rounded(raster.window(pixels(spark, sf), 3, 20, 10, 40), value=F.col("value"))


@query("SELECT p_partkey, CAST(k AS INT) AS tile, CAST(k % nx * 16 AS INT) AS c0, CAST(least((k % nx + 1) * 16, w) AS INT) AS c1, CAST(k // nx * 16 AS INT) AS r0, CAST(least((k // nx + 1) * 16, h) AS INT) AS r1 FROM (SELECT p_partkey, p_size + 20 AS w, p_size * 2 AS h, CAST(ceil((p_size + 20) / 16) AS INT) AS nx, CAST(ceil(p_size * 2 / 16) AS INT) AS ny FROM part), unnest(range(0, nx * ny)) AS r(k)")
def tile_extents(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", F.inline(raster.tile_extents(p.p_size + 20, p.p_size * 2, 16)))


@query(f"WITH {PX}, s AS (SELECT row, col, row + 0.25e0 AS y, col + 0.5e0 AS x FROM px), n AS (SELECT s.row, s.col, (CASE WHEN i=0 THEN 0.5e0 ELSE 0.5e0 END)*(CASE WHEN j=0 THEN 0.75e0 ELSE 0.25e0 END) AS w, px.value FROM s, unnest([0,1]) AS a(i), unnest([0,1]) AS b(j) LEFT JOIN px ON px.row = s.row + j AND px.col = s.col + i) SELECT row, col, round(CASE WHEN count(*) = count(value) THEN sum(w*value) END,6) AS value FROM n GROUP BY 1, 2")
def bilinear_resample(spark, sf):
    px = pixels(spark, sf)
    at = px.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.25).alias("y"))
    out = raster.bilinear(at.withColumnsRenamed({"row": "r", "col": "c"}), px, ["r", "c"], "x", "y")
    return out.select(F.col("r").alias("row"), F.col("c").alias("col"), F.round("value", 6).alias("value"))


@query(f"WITH {PX} SELECT s.s_suppkey, round(px.value,6) AS value FROM supplier s LEFT JOIN px ON px.row = floor(abs(s_acctbal) / 25 + 0.5) AND px.col = floor(s_suppkey * 0.7e0 % 70 + 0.5)")
def nearest_sample(spark, sf):
    s = t(spark, sf, "supplier")
    at = s.select("s_suppkey", (s.s_suppkey * 0.7 % 70).alias("x"), (F.abs(s.s_acctbal) / 25).alias("y"))
    return raster.nearest(at, pixels(spark, sf), "x", "y").select("s_suppkey", F.round("value", 6).alias("value"))


def cube(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("int").alias("row"), F.lit(0).alias("col"), F.dayofmonth("ts").alias("t")).agg(F.avg("value").alias("value"))


CUBE = "cube AS (SELECT CAST(user_id AS INT) AS row, 0 AS col, CAST(day(ts) AS INT) AS t, avg(value) AS value FROM events GROUP BY 1, 3)"


@query(f"WITH {CUBE} SELECT row, col FROM cube WHERE abs(value) <= 40 GROUP BY 1, 2 HAVING count(value) >= 20")
def mask_min_count(spark, sf):
    return raster.valid_at_least(cube(spark, sf), 20, 40.0)


@query(f"WITH {CUBE}, g AS (SELECT u AS row, d AS col FROM unnest(range(0, (SELECT max(row) + 1 FROM cube))) AS a(u), unnest(range(0, (SELECT max(t) + 1 FROM cube))) AS b(d)) SELECT CAST(g.row AS INT) AS row, CAST(g.col AS INT) AS col, round(value,6) AS value FROM g LEFT JOIN cube ON cube.row = g.row AND cube.t = g.col")
def border_fill(spark, sf):
    px = cube(spark, sf).select("row", F.col("t").alias("col"), "value")
    most = px.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    rows, cols = (0, 0) if most.row is None else (most.row + 1, most.col + 1)
    return rounded(raster.fill_grid(px, rows, cols), value=F.col("value"))


@query(f"WITH {PX}, two AS (SELECT *, 1 AS tile FROM px WHERE row < 200 AND value > 0 UNION ALL SELECT row, col, value * 2, 2 FROM px WHERE row >= 150) SELECT row, col, round(arg_min(value, tile),6) AS value FROM two GROUP BY 1, 2")
def mosaic(spark, sf):
    px = pixels(spark, sf)
    two = px.filter("row < 200").withColumn("value", F.when(F.col("value") > 0, F.col("value"))).withColumn("tile", F.lit(1)).unionByName(px.filter("row >= 150").withColumn("value", F.col("value") * 2).withColumn("tile", F.lit(2)))
    return rounded(raster.mosaic(two, "tile"), value=F.col("value"))


@query("SELECT CAST(s_nationkey AS INT) AS band, s_suppkey AS raster_id, CASE WHEN s_nationkey IN (3, 7) THEN -1e0 ELSE s_acctbal END AS value, 'Band' || s_nationkey || '_' || s_suppkey AS band_name FROM supplier")
def band_stack(spark, sf):
    s = t(spark, sf, "supplier")
    px = s.select(s.s_nationkey.alias("band"), s.s_suppkey.alias("raster_id"), F.when(s.s_nationkey.isin(3, 7), F.lit(0.0)).otherwise(s.s_acctbal).alias("value"))
    return raster.stack(px, [0.0], -1.0)


NCC_PX = f"{PX}, im AS (SELECT a.row, a.col, a.value AS base, b.value AS target FROM px a JOIN px b ON b.row = a.row - 1 AND b.col = a.col - 2)"


@query(f"""WITH {NCC_PX}, m AS (SELECT b.row // 8 AS wr, b.col // 8 AS wc, dx, dy, corr(b.base, t.target) AS score, count(*) AS n FROM im b, unnest(range(-2, 3)) AS x(dx), unnest(range(-2, 3)) AS y(dy), im t WHERE t.row = b.row + dy AND t.col = b.col + dx GROUP BY 1, 2, 3, 4)
SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(score,6) AS score FROM m WHERE n = 64 QUALIFY row_number() OVER (PARTITION BY wr, wc ORDER BY round(score,9) DESC, abs(dx) + abs(dy), dx DESC, dy DESC) = 1""")
def ncc_integer(spark, sf):
    px = pixels(spark, sf)
    shifted = px.select((F.col("row") + 1).alias("row"), (F.col("col") + 2).alias("col"), F.col("value").alias("target"))
    im = px.withColumnRenamed("value", "base").join(shifted, ["row", "col"])
    return rounded(correlate.ncc_table(im, 8, 2), score=F.col("score"))


def _images(spark, sf):
    px = pixels(spark, sf)
    shifted = px.select((F.col("row") + 1).alias("row"), (F.col("col") + 2).alias("col"), F.col("value").alias("target"))
    return px.withColumnRenamed("value", "base").join(shifted, ["row", "col"], "left").select(F.lit(0).cast("long").alias("pair_id"), "row", "col", "base", F.coalesce("target", F.lit(0.0)).alias("target"))


@query()
def ncc_subpixel(spark, sf):
    tiles = correlate.halo_tiles(_images(spark, sf), 16, 4, 16 - 8)
    return rounded(correlate.correlate(tiles, "spatial", 16, 8, 4), dx=F.col("dx"), dy=F.col("dy"), snr=F.col("snr"))


@query()
def freq_correlate(spark, sf):
    tiles = correlate.halo_tiles(_images(spark, sf), 32, 0)
    return rounded(correlate.correlate(tiles, "frequency", 32, 32), dx=F.col("dx"), dy=F.col("dy"), snr=F.col("snr"))


# time series
def _filled(spark, sf):
    c = cube(spark, sf)
    kept = raster.valid_at_least(c, 15)
    return series.fill_mean(c.join(kept, ["row", "col"]), ["row", "col"], list(range(1, 31)))


@query(f"WITH {CUBE}, d AS (SELECT * FROM cube WHERE t <= 30) SELECT a.t AS t1, b.t AS t2, round(sum(a.value*b.value),4) AS g FROM d a JOIN d b USING (row, col) GROUP BY 1, 2")
def pcaim_gram(spark, sf):
    return rounded(series.gram_table(cube(spark, sf).filter("t <= 30"), ["row", "col"]), 4, g=F.col("g"))


@query(f"WITH {CUBE}, n AS (SELECT t, count(value) AS n FROM cube GROUP BY 1), p AS (SELECT count(DISTINCT row) AS p FROM cube) SELECT t, p - n AS n_missing, round(pow(n / (p * 1e0), 2) / max(pow(n / (p * 1e0), 2)) OVER (), 6) AS weight FROM n, p")
def slice_weights(spark, sf):
    c = cube(spark, sf)
    return rounded(series.slice_weights(c, c.select("row", "col").distinct().count(), 2.0), weight=F.col("weight"))


@query()
def pcaim_fit(spark, sf):
    _, s, chis, _ = series.pcaim(_filled(spark, sf), 30, 2)
    return spark.createDataFrame([(i, round(float(a), 4), round(float(b), 4)) for i, (a, b) in enumerate(zip(s, chis, strict=True))], "component int, s double, chi2 double")


@query()
def ica_fit(spark, sf):
    _, out = series.ica(_filled(spark, sf), 30, 2)
    return out.select("row", "col", F.transform("ic", lambda v: F.round(v, 4)).alias("ic"))


@query("WITH s AS (SELECT l_linenumber AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1), p AS (SELECT k, s, round(100*s*s/sum(s*s) OVER (),2) AS pct FROM s) SELECT k, s, pct, sum(pct) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM p")
def explained_variance(spark, sf):
    s = t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("s"))
    return stats.explained_variance(s, "s", "k").withColumn("cum", F.round("cum", 2))


# text
_LINES = ", ".join(f"('{x}')" for x in RPC_TEXT.strip().splitlines())


@query(rf"WITH v(value) AS (VALUES {_LINES}), m AS (SELECT regexp_extract(value, '^\s*([A-Z_]+?)(?:_(\d+))?\s*:\s*([-+0-9.eE]+)', ['k','i','c']) AS m FROM v) SELECT m.k AS key, coalesce(CAST(nullif(m.i, '') AS INT), 0) AS idx, CAST(m.c AS DOUBLE) AS coeff FROM m")
def rpc_text_parse(spark, sf):
    return rpc_entries(spark.createDataFrame([(x,) for x in [*RPC_TEXT.strip().splitlines(), "no key here"]], "value string"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) || '_VS_' || 'base' || '_frequency_wz_64_step_8.tif' AS name FROM pages")
def name_parts(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", stem(p.url).alias("stem"), correlation_name(p.url, F.lit("/x/base.tif"), "frequency", 64, 8).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT s_suppkey * 1e0 AS ref_x, s_nationkey * 1e0 AS ref_y, s_acctbal AS raw_x, s_nationkey + 0.5e0 AS raw_y FROM supplier WHERE s_suppkey % 5 <> 0")
def tie_points(spark, sf):
    s = t(spark, sf, "supplier")
    line = F.concat_ws("\t", s.s_suppkey.cast("string"), s.s_nationkey.cast("string"), s.s_acctbal.cast("string"), (s.s_nationkey + 0.5).cast("string"))
    return parse_tie_points(s.select(F.when(s.s_suppkey % 5 == 0, F.concat(F.lit("; "), line)).otherwise(line).alias("value")))
