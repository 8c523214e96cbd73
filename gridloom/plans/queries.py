"""The registered queries over the carrier views, each with a SQL twin written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, geodesy, text
from ..operators import attributes, grid, image, vector
from ..sources import gnis, sdts
from .carriers import geo_points, grid_cells, line_attrs, line_pts, table, topology, with_views
from .registry import query

A, E2, M0, M2, M4, M6 = (repr(v) for v in geodesy.DATUMS["nad27"])
HALF_TURN = "3.141592653589793"


def forward_sql(src: str, lat: str = "lat", lon: str = "lon") -> str:
    """SQL for the forward projection of ``src`` with all its columns."""
    return f"""(select * exclude (_phi, _z, _s, _w, _c, _nu, _rho, _t2, _p, _m), 500000 + 0.9996 * _nu * _c * (_w + pow(_w, 3) / 6 * pow(_c, 2) * (_p - _t2)
  + pow(_w, 5) / 120 * pow(_c, 4) * (4 * pow(_p, 3) * (1 - 6 * _t2) + pow(_p, 2) * (1 + 8 * _t2) - 2 * _p * _t2 + _t2 * _t2)
  + pow(_w, 7) / 5040 * pow(_c, 6) * (61 - 479 * _t2 + 179 * _t2 * _t2 - pow(_t2, 3))) as utm_x,
  0.9996 * (_m + _w * _w / 2 * _nu * _s * _c + pow(_w, 4) / 24 * _nu * _s * pow(_c, 3) * (4 * _p * _p + _p - _t2)
  + pow(_w, 6) / 720 * _nu * _s * pow(_c, 5) * (8 * pow(_p, 4) * (11 - 24 * _t2) - 28 * pow(_p, 3) * (1 - 6 * _t2) + _p * _p * (1 - 32 * _t2) - 2 * _p * _t2 + _t2 * _t2)
  + pow(_w, 8) / 40320 * _nu * _s * pow(_c, 7) * (1385 - 3111 * _t2 + 543 * _t2 * _t2 - pow(_t2, 3))) as utm_y, _z as utm_zone
from (select *, pow(_s / _c, 2) as _t2, _nu / _rho as _p, {A} * ({M0} * _phi - {M2} * sin(2 * _phi) + {M4} * sin(4 * _phi) - {M6} * sin(6 * _phi)) as _m
from (select *, sqrt(1 - _s * _s) as _c, {A} / sqrt(1 - {E2} * _s * _s) as _nu, {A} * (1 - {E2}) / pow(1 - {E2} * _s * _s, 1.5) as _rho
from (select *, sin(_phi) as _s, radians({lon} - (_z * 6 - 183)) as _w from (select *, radians({lat}) as _phi, cast(greatest(1, least(60, ceil(({lon} + 180) / 6))) as int) as _z from {src})))))"""


def inverse_sql(src: str) -> str:
    now = f"(select *, utm_y / 0.9996 as _y, (utm_x - 500000) / 0.9996 as _x, 0.7853981633974483 as _f0 from {src})"
    for k in range(geodesy.NEWTON_STEPS):
        g = f"_f{k}"
        now = f"(select *, {g} - ({A} * ({M0} * {g} - {M2} * sin(2 * {g}) + {M4} * sin(4 * {g}) - {M6} * sin(6 * {g})) - _y) / ({A} * ({M0} - 2 * {M2} * cos(2 * {g}) + 4 * {M4} * cos(4 * {g}) - 6 * {M6} * cos(6 * {g}))) as _f{k + 1} from {now})"
    g = f"_f{geodesy.NEWTON_STEPS}"
    return f"""(select *, degrees({g} - tan({g}) / _rho * (_q * _x / 2 - _x * pow(_q, 3) / 24 * (-4 * _p * _p + 9 * _p * (1 - _t2) + 12 * _t2)
  + _x * pow(_q, 5) / 720 * (8 * pow(_p, 4) * (11 - 24 * _t2) - 12 * pow(_p, 3) * (21 - 71 * _t2) + 15 * _p * _p * (15 - 98 * _t2 + 15 * _t2 * _t2) + 180 * _p * (5 * _t2 - 3 * _t2 * _t2) + 360 * _t2 * _t2)
  - _x * pow(_q, 7) / 40320 * (1385 + 3633 * _t2 + 4095 * _t2 * _t2 + 1575 * pow(_t2, 3)))) as geo_lat,
  degrees((_q - pow(_q, 3) / 6 * (_p + 2 * _t2) + pow(_q, 5) / 120 * (-4 * pow(_p, 3) * (1 - 6 * _t2) + _p * _p * (9 - 68 * _t2) + 72 * _p * _t2 + 24 * _t2 * _t2)
  - pow(_q, 7) / 5040 * (61 + 662 * _t2 + 1320 * _t2 * _t2 + 720 * pow(_t2, 3))) / cos({g})) + utm_zone * 6 - 183 as geo_lon
from (select *, _x / _nu as _q, _nu / _rho as _p, pow(tan({g}), 2) as _t2 from (select *, {A} / sqrt(1 - {E2} * sin({g}) * sin({g})) as _nu, {A} * (1 - {E2}) / pow(1 - {E2} * sin({g}) * sin({g}), 1.5) as _rho from {now})))"""


PTS = with_views("geo_points")
CELLS = with_views("grid_cells")


# Projection

@query("utm_forward", f"{PTS} select id, round(utm_x, 3) as utm_x, round(utm_y, 3) as utm_y, utm_zone from {forward_sql('geo_points')}")
def utm_forward(spark, d):
    return geodesy.add_utm(geo_points(spark, d), "lat", "lon").select("id", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"), "utm_zone")


@query("utm_zone_counts", f"{PTS} select cast(ceil((lon + 180) / 6) as int) as zone, count(*) as n from geo_points where lat between 30 and 45 and lon between -120 and -80 group by 1")
def utm_zone_counts(spark, d):
    some = geo_points(spark, d).filter(F.col("lat").between(30, 45) & F.col("lon").between(-120, -80))
    return some.groupBy(geodesy.utm_zone(F.col("lon")).alias("zone")).agg(F.count("*").alias("n"))


@query("utm_zone_boundary", "select o_orderkey as id, case when o_orderkey % 61 = 0 then 1 else cast(o_orderkey % 61 as int) end as west, case when o_orderkey % 61 = 60 then 60 else cast(o_orderkey % 61 + 1 as int) end as east from orders")
def utm_zone_boundary(spark, d):
    lon = (F.col("o_orderkey") % 61 * 6 - 180).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), geodesy.utm_zone(lon).alias("west"), geodesy.utm_zone(lon, True).alias("east"))


@query("utm_inverse", f"{PTS} select id, round(geo_lat, 7) as lat, round(geo_lon, 7) as lon from {inverse_sql('(select id, 300000 + id * 131.0::double % 400000 as utm_x, 2700000 + id * 977.0::double % 2500000 as utm_y, cast(10 + id % 10 as int) as utm_zone from geo_points)')}")
def utm_inverse(spark, d):
    k = F.col("id")
    pts = geo_points(spark, d).select("id", (300000 + k * 131.0 % 400000).alias("x"), (2700000 + k * 977.0 % 2500000).alias("y"), (10 + k % 10).cast("int").alias("zone"))
    return geodesy.add_latlon(pts, "x", "y", "zone").select("id", F.round("geo_lat", 7).alias("lat"), F.round("geo_lon", 7).alias("lon"))


@query("utm_roundtrip_err", f"{PTS} select count(*) as n, 0 as far from geo_points")
def utm_roundtrip_err(spark, d):
    back = geodesy.add_latlon(geodesy.add_utm(geo_points(spark, d), "lat", "lon"), "utm_x", "utm_y", "utm_zone")
    far = (F.abs(F.col("geo_lat") - F.col("lat")) > 1e-9) | (F.abs(F.col("geo_lon") - F.col("lon")) > 1e-9)
    return back.agg(F.count("*").alias("n"), F.coalesce(F.sum(far.cast("int")), F.lit(0)).cast("int").alias("far"))


@query("bbox_search", f"{PTS} select id, name, lat, lon from geo_points where lat between 33 and 34 and lon between -118 and -100")
def bbox_search(spark, d):
    return gnis.search(geo_points(spark, d), (34, -100, 33, -118)).select("id", "name", "lat", "lon")


@query("dms_decode", f"""{PTS}, t as (select id, printf('%02d%02d%02d%s', cast(floor(lat) as int), cast(id % 60 as int), cast(id * 7 % 60 as int), case when id % 2 = 0 then 'N' else 'S' end) as s from geo_points)
select id, round((cast(substr(s, 1, 2) as double) + cast(substr(s, 3, 2) as double) / 60 + cast(substr(s, 5, 2) as double) / 3600) * case when substr(s, 7, 1) = 'S' then -1 else 1 end, 9) as lat from t""")
def dms_decode(spark, d):
    s = F.format_string("%02d%02d%02d%s", F.floor("lat").cast("int"), (F.col("id") % 60).cast("int"), (F.col("id") * 7 % 60).cast("int"), F.when(F.col("id") % 2 == 0, "N").otherwise("S"))
    return geo_points(spark, d).select("id", F.round(text.dms_to_degrees(s, 2), 9).alias("lat"))


@query("dms_encode", f"{PTS} select id, sign_ as sign, deg, min_ as min, round((((a - deg) * 60) - min_) * 60, 6) as sec from (select *, cast(floor((a - deg) * 60) as int) as min_ from (select *, case when lon < 0 then -1 else 1 end as sign_, abs(lon) as a, cast(floor(abs(lon)) as int) as deg from geo_points))")
def dms_encode(spark, d):
    return geo_points(spark, d).select("id", text.degrees_to_dms(F.col("lon")).alias("t")).select("id", "t.sign", "t.deg", "t.min", F.round("t.sec", 6).alias("sec"))


@query("sheet_code", """with t as (select p_partkey as id, cast(p_partkey % 18 as int) as letter, cast(p_partkey % 12 + 1 as int) as n, cast(p_partkey % 60 + 1 as int) as z, case when p_partkey % 2 = 0 then 'E' else 'W' end as h, case when p_partkey % 3 = 0 then 'S' else 'N' end as ns from part),
u as (select *, letter * 4 + 3 - cast(floor((n - 1) / 3.0) as int) as low from t)
select id, case when ns = 'S' then -(low + 1) else low end as sw_lat, cast(-186 + 6 * z + 2 * ((n + 2) % 3) + case when h = 'E' then 1 else 0 end as int) as sw_lon from u""")
def sheet_code(spark, d):
    k = F.col("p_partkey")
    code = F.format_string("NAME %s%s%02d-%02d%s", F.when(k % 3 == 0, "S").otherwise("N"), F.char(65 + k % 18), (k % 60 + 1).cast("int"), (k % 12 + 1).cast("int"), F.when(k % 2 == 0, "E").otherwise("W"))
    return table(spark, d, "part").select(k.alias("id"), geodesy.sheet_corners(code).alias("c")).select("id", "c.sw_lat", "c.sw_lon")


@query("quad_name", f"""{PTS}, t as (select id, abs(lat) + 0.02 as la, abs(lon) + 0.02 as lo from geo_points)
select id, printf('%02d%03d', cast(floor(la) as int), cast(floor(lo) as int)) || chr(cast(97 + floor((la - floor(la)) * 8) as int)) || cast(cast(1 + floor((lo - floor(lo)) * 8) as int) as varchar) as quad from t""")
def quad_name(spark, d):
    return geo_points(spark, d).select("id", geodesy.quad_name(F.col("lat"), F.col("lon")).alias("quad"))


@query("latlon_to_pixel", f"{PTS} select id, cast(-1 + round((lon + 125) * 600 / 58) as int) as x, cast(399 - round((lat - 24) * 400 / 25) as int) as y from geo_points")
def latlon_to_pixel(spark, d):
    x, y = image.to_pixel(F.col("lat"), F.col("lon"), image.Frame((24.0, -125.0, 49.0, -67.0), 600, 400))
    return geo_points(spark, d).select("id", x.alias("x"), y.alias("y"))


# Place names

_G = f"""{PTS}, t as (select id, name, class, case when id % 9 = 4 then null else printf('%02d%02d%02dN', cast(floor(lat) as int), cast(id % 60 as int), cast(id * 7 % 60 as int)) end as la, printf('%03d%02d%02dW', cast(floor(-lon) as int), cast(id * 3 % 60 as int), cast(id * 11 % 60 as int)) as lo from geo_points),
v as (select *, cast(substr(la, 1, 2) as double) + cast(substr(la, 3, 2) as double) / 60 + cast(substr(la, 5, 2) as double) / 3600 as flat, -(cast(substr(lo, 1, 3) as double) + cast(substr(lo, 4, 2) as double) / 60 + cast(substr(lo, 6, 2) as double) / 3600) as flon from t)"""


def _gnis_rows(spark, d, fmt: str):
    k = F.col("id")
    la = F.when(k % 9 != 4, F.format_string("%02d%02d%02dN", F.floor("lat").cast("int"), (k % 60).cast("int"), (k * 7 % 60).cast("int")))
    lo = F.format_string("%03d%02d%02dW", F.floor(-F.col("lon")).cast("int"), (k * 3 % 60).cast("int"), (k * 11 % 60).cast("int"))
    raw = {
        "fixed": F.concat(F.lit("MT "), F.rpad("name", 51, " "), F.rpad("class", 26, " "), F.coalesce(la, F.lit("UNKNOWN")), F.lit(" "), lo, F.lit("      5640")),
        "quoted": F.concat(F.lit('"MT","'), F.col("name"), F.lit('","'), F.col("class"), F.lit('","c","30","063","'), F.coalesce(la, F.lit("")), F.lit('","'), lo, F.lit('"'), F.when(k % 9 != 4, F.concat(F.lit(',"'), F.format_string("%.5f", "lat"), F.lit('","'), F.format_string("%.5f", "lon"), F.lit('",""'))).otherwise(F.lit(""))),
        "piped": F.concat(k.cast("string"), F.lit("|"), F.col("name"), F.lit("|"), F.col("class"), F.lit("|MT|30|c|063|x|y|"), F.format_string("%.5f", "lat"), F.when(k % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("|"), F.format_string("%.5f", "lon"), F.lit("|||")))),
    }[fmt]
    return gnis.parse(geo_points(spark, d).select("id", raw.alias("raw")))


@query("gnis_fixed", f"{_G} select id, name, class, 'MT' as state, round(flat, 7) as lat, round(flon, 7) as lon from v where la is not null")
def gnis_fixed(spark, d):
    return _gnis_rows(spark, d, "fixed").filter("reason is null").select("id", "name", "class", "state", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("gnis_quoted", f"{PTS} select id, name, class, 'MT' as state, round(lat, 5) as lat, round(lon, 5) as lon from geo_points where id % 9 <> 4")
def gnis_quoted(spark, d):
    return _gnis_rows(spark, d, "quoted").filter("reason is null").select("id", "name", "class", "state", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("gnis_pipe", f"{PTS} select id, name, class, 'MT' as state, round(lat, 5) as lat, round(lon, 5) as lon from geo_points where id % 9 <> 4")
def gnis_pipe(spark, d):
    return _gnis_rows(spark, d, "piped").filter("reason is null").select("id", "name", "class", "state", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("gnis_rejects", f"{PTS}, f(fmt) as (values ('fixed'), ('quoted'), ('piped')) select fmt, count(*) as n from geo_points, f where id % 9 = 4 group by 1")
def gnis_rejects(spark, d):
    rows = [_gnis_rows(spark, d, k).filter("reason is not null").select("fmt") for k in ("fixed", "quoted", "piped")]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("fmt").agg(F.count("*").alias("n"))


# Grids

@query("grid_minmax_loc", f"{CELLS}, c as (select * from grid_cells where elev is not null) select a.elev as min_elev, a.i as min_i, a.j as min_j, b.elev as max_elev, b.i as max_i, b.j as max_j from (select * from c order by elev, i, j limit 1) a, (select * from c order by elev desc, i, j limit 1) b")
def grid_minmax_loc(spark, d):
    return grid.extremes(grid_cells(spark, d))


@query("grid_tile_stats", f"{CELLS} select cast(floor(i / 16.0) as int) as ti, cast(floor(j / 16.0) as int) as tj, count(elev) as n, min(elev) as lo, max(elev) as hi from grid_cells group by 1, 2")
def grid_tile_stats(spark, d):
    return grid.tile_stats(grid_cells(spark, d))


@query("grid_profiles", f"{CELLS} select j, count(elev) as n, coalesce(min(elev), 100000) as lo, coalesce(max(elev), -100000) as hi from grid_cells group by 1")
def grid_profiles(spark, d):
    return grid.profile_stats(grid_cells(spark, d))


@query("grid_mosaic_last_wins", f"{CELLS}, t as (select seq, i % 40 as i, j, elev, row_number() over (partition by i % 40, j, seq order by i desc) as k from grid_cells where elev is not null) select i, j, elev from (select *, row_number() over (partition by i, j order by seq desc) as r from t where k = 1) where r = 1")
def grid_mosaic_last_wins(spark, d):
    cells = grid_cells(spark, d).filter("elev is not null").select((F.col("seq") * 1000 + F.floor(F.col("i") / 40)).alias("seq"), (F.col("i") % 40).alias("i"), "j", "elev")
    return grid.mosaic(cells)


@query("grid_transpose", f"{CELLS} select j as i, i as j, elev from grid_cells")
def grid_transpose(spark, d):
    return grid.transpose(grid_cells(spark, d).select("i", "j", "elev"))


@query("grid_resample_nearest", f"{CELLS}, p as (select cast(a.range as int) as i, cast(b.range as int) as j, cast(round(149.0::double * a.range / 59) as int) as k, cast(round(99.0::double * b.range / 79) as int) as l from range(60) a, range(80) b) select p.i, p.j, c.elev from p left join grid_cells c on c.i = p.k and c.j = p.l")
def grid_resample_nearest(spark, d):
    cells = grid_cells(spark, d)
    last = cells.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    return grid.resample(cells, (last.i or 0) + 1, (last.j or 0) + 1, 80, 60)


def _smooth_sql(weights, keep):
    rows = ", ".join(f"({a}, {b}, {w})" for a, b, w in weights if w > 0)
    mean = "cast(round(sum(n.elev * w)::double / sum(case when n.elev is not null then w end)) as int)"
    return f"{CELLS}, w(a, b, w) as (values {rows}) select c.i, c.j, {f'case when any_value(c.elev) is not null then {mean} end' if keep else mean} as elev from grid_cells c cross join w left join grid_cells n on n.i = c.i - w.a and n.j = c.j - w.b group by 1, 2"


_BOX, _BELL = grid.kernel(1), grid.kernel(2, 2.0)


@query("grid_box_smooth", _smooth_sql(_BOX, True))
def grid_box_smooth(spark, d):
    return grid.smooth(grid_cells(spark, d), _BOX, keep_void=True)


@query("grid_gauss_smooth", _smooth_sql(_BELL, False))
def grid_gauss_smooth(spark, d):
    return grid.smooth(grid_cells(spark, d), _BELL)


def _interp_sql(n):
    return f"{CELLS}, p as (select i, j, elev, lead(elev) over w as nxt, lead(j) over w as jn from grid_cells window w as (partition by i order by j)) select i, cast(j * {n} + k as int) as j, case when k = 0 then elev else cast(round((elev * ({n} - k) + nxt * k)::double / {n}) as int) end as elev from p, (select cast(range as int) as k from range({n})) where k = 0 or jn = j + 1"


@query("grid_interp_mid", _interp_sql(2))
def grid_interp_mid(spark, d):
    return grid.interpolate_columns(grid_cells(spark, d), 2)


@query("grid_interp_third", _interp_sql(3))
def grid_interp_third(spark, d):
    return grid.interpolate_columns(grid_cells(spark, d), 3)


_PAIRS = ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(grid.BRIDGES))


@query("grid_void_fill_parallel", f"{CELLS}, p(k, ai, aj, bi, bj) as (values {_PAIRS}), s as (select c.i, c.j, trunc(sum(a.elev + b.elev)::double / (2 * count(*))) as v from grid_cells c cross join p join grid_cells a on a.i = c.i + p.ai and a.j = c.j + p.aj join grid_cells b on b.i = c.i + p.bi and b.j = c.j + p.bj where c.elev is null and a.elev is not null and b.elev is not null group by 1, 2) select c.i, c.j, coalesce(c.elev, cast(s.v as int)) as elev from grid_cells c left join s on s.i = c.i and s.j = c.j")
def grid_void_fill_parallel(spark, d):
    return grid.fill_voids_parallel(grid_cells(spark, d))


@query("grid_void_fill")
def grid_void_fill(spark, d):
    return grid.fill_voids(grid_cells(spark, d))


_NEAR = f"{CELLS}, n as (select c.i, c.j, c.elev, case when c.elev is null or u.elev is null or w.elev is null then null else greatest((w.elev - c.elev) / (sqrt(2.0::double / 2880000) * sqrt(pow(110950.0::double, 2) + pow(111320.0::double * cos(radians(60.0::double - c.i / 1200.0::double)), 2))), (u.elev - c.elev) / (110950.0::double / 1200), -1e10::double) end as g from grid_cells c left join grid_cells u on u.i = c.i - 1 and u.j = c.j left join grid_cells w on w.i = c.i - 1 and w.j = c.j - 1)"


def _gradient(spark, d):
    """1200 rows a degree, the first at 60 degrees north."""
    return grid.gradient(grid_cells(spark, d), 110950.0 / 1200, grid.row_spacing(F.col("i"), 60.0, 1.0, 1.0, 1200, 1200))


@query("grid_gradient", f"{_NEAR} select i, j, round(g, 9) as gradient from n")
def grid_gradient(spark, d):
    return _gradient(spark, d).select("i", "j", F.round("gradient", 9).alias("gradient"))


def _factor_sql(g="g"):
    return "case when g is null then null " + " ".join(f"when (atan({g}) + 1.5707963267948966) / {HALF_TURN} < {t} then {k}" for k, t in enumerate(color.TURNS)) + " else 15 end"


def _band_sql(limits):
    return "case " + " ".join(f"when elev <= {v} then {k}" for k, v in enumerate(limits)) + " end"


def _relief_sql(limits, sea=False):
    zero = f"case when g = 0 then {color.BRIGHT_BLUE} else 160 + f end" if sea else "f"
    return f"{_NEAR}, s as (select *, {_factor_sql()} as f from n) select i, j, cast(case when elev is null or g is null then {color.WHITE} when elev < 0 then 160 + f when elev = 0 then {zero} else {_band_sql(limits)} * 16 + f end as int) as color from s"


@query("grid_shade", _relief_sql(color.LIMITS))
def grid_shade(spark, d):
    return _gradient(spark, d).select("i", "j", color.relief_color(F.col("elev"), F.col("gradient")).alias("color"))


_LIM = color.stretched(-93, 3233)


@query("grid_shade_rescaled", _relief_sql(_LIM))
def grid_shade_rescaled(spark, d):
    span = grid_cells(spark, d).agg(F.min("elev").alias("low"), F.max("elev").alias("high")).first()
    limits = color.stretched(span.low or 0, span.high or 0)
    return _gradient(spark, d).select("i", "j", color.relief_color(F.col("elev"), F.col("gradient"), limits).alias("color"))


@query("grid_sea", _relief_sql(color.LIMITS, True))
def grid_sea(spark, d):
    return _gradient(spark, d).select("i", "j", color.relief_color(F.col("elev"), F.col("gradient"), seacoast=True).alias("color"))


@query("grid_band", f"{CELLS} select {_band_sql(color.LIMITS)} as band, count(*) as n from grid_cells where elev is not null group by 1")
def grid_band(spark, d):
    return grid_cells(spark, d).filter("elev is not null").groupBy(color.band_of(F.col("elev")).alias("band")).agg(F.count("*").alias("n"))


def _contour_sql(fill):
    plain = "cast(((cast(round(floor(c.v / 500.0::double)) as int) % 13) + 13) % 13 * 16 as int)" if fill else str(color.WHITE)
    return f"{CELLS}, q as (select i, j, cast(round(ceil(floor(coalesce(elev, {color.NO_DATA}) / 500.0::double) * 500)) as int) as v from grid_cells) select c.i, c.j, case when count(n.v) < 8 then {color.WHITE} when any_value(c.v) > min(n.v) then {color.ORANGE} else any_value({plain}) end as color from q c left join q n on n.i between c.i - 1 and c.i + 1 and n.j between c.j - 1 and c.j + 1 and (n.i <> c.i or n.j <> c.j) where c.i >= 1 and c.j >= 1 group by 1, 2"


@query("grid_contour", _contour_sql(False))
def grid_contour(spark, d):
    return grid.contours(grid_cells(spark, d), 500.0)


@query("grid_contour_fill", _contour_sql(True))
def grid_contour_fill(spark, d):
    return grid.contours(grid_cells(spark, d), 500.0, fill=True)


@query("grid_height_field", f"{CELLS} select i, j, cast(round(greatest(coalesce(elev, 0), 0) * 65535.0::double / (select max(elev) from grid_cells)) as int) as height from grid_cells")
def grid_height_field(spark, d):
    return grid.height_field(grid_cells(spark, d).select("i", "j", "elev"))


_RAMP = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate((*color.PALETTES[1], (0, 0, 0), (0, 0, 0))))


@query("shade_ramp", f"with b(k, r0, g0, b0) as (values {_RAMP}), j as (select cast(range as int) as j from range(16)) select cast(k * 16 + j as int) as idx, " + ", ".join(f"cast(case when j = 15 then 0 else {c}0 - round(j * {c}0 / 15.0::double) end as int) as {c}" for c in "rgb") + " from b, j")
def shade_ramp(spark, d):
    return color.shade_ramp(spark, 1)


# Attributes

_RULES = (("L", 50, -1), ("L", 170, 203), ("L", 10000, 77))
_LA = with_views("line_attr", "topology")


@query("attr_rule_lines", f"{_LA} select id, bool_or(major = 50 or (major = 170 and minor = 203)) as drawn from line_attr group by 1")
def attr_rule_lines(spark, d):
    return line_attrs(spark, d).select("id", vector.matches_rules(F.col("attrs"), _RULES[:2]).alias("drawn"))


def _drawn(spark, d, attrs, theme, rules):
    t = topology(spark, d).withColumn("attrs", attrs)
    return t.select("id", vector.draws_line(F.col("attrs"), F.col("id"), theme, F.col("left_area"), F.col("right_area"), rules).alias("drawn")).filter("drawn").select("id")


def _bare():
    return F.expr("cast(array() as array<struct<major:int,minor:int>>)")


@query("attr_rule_unattributed", f"{_LA} select id from topology where (left_area <> 1 and right_area <> 1 and id % 3 = 0) or id = 77")
def attr_rule_unattributed(spark, d):
    return _drawn(spark, d, _bare(), F.when(F.col("id") % 3 == 0, 50).otherwise(90), _RULES)


@query("attr_rule_by_id", f"{_LA} select id from topology where id = 77 or id = 78")
def attr_rule_by_id(spark, d):
    return _drawn(spark, d, _bare(), F.lit(90), (("L", 10000, 77), ("L", 10000, 78)))


@query("attr_rule_default", f"{_LA} select id from topology where left_area <> 1 and right_area <> 1")
def attr_rule_default(spark, d):
    return _drawn(spark, d, _bare(), F.lit(90), ())


@query("attr_uniq", f"{_LA}, m as (select id, k, major, minor, max(k) over (partition by id, major, minor) as last from line_attr) select id, string_agg(major || '.' || minor, ' ' order by k) as attrs from m where k = last group by 1")
def attr_uniq(spark, d):
    return line_attrs(spark, d).select("id", F.array_join(F.transform(vector.unique_attributes(F.col("attrs")), lambda a: F.concat_ws(".", a["major"].cast("string"), a["minor"].cast("string"))), " ").alias("attrs"))


@query("attr_decode_flags", "with t as (select p_partkey as id, cast(p_partkey % 9 as int) as key, case when p_size % 2 = 0 then 'Y' else 'N' end as v from part) select id, case when key < 7 then 20 else 26 end as major, case key when 0 then 202 when 1 then 204 when 2 then 610 when 3 then 611 when 4 then 612 when 5 then 613 when 6 then 614 else 0 end as minor from t where v = 'Y' and key <> 7")
def attr_decode_flags(spark, d):
    names = [r[3] for r in attributes.FEATURES if r[0] < 9]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(20).alias("category"), name.alias("label"), F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N").alias("value"))
    return attributes.decode(rows).select("id", "major", "minor")


@query("attr_decode_codes", "select p_partkey as id, 170 as major, case p_partkey % 5 when 0 then 601 when 1 then 606 when 2 then 612 when 3 then 614 else 618 end as minor from part")
def attr_decode_codes(spark, d):
    letter = F.substring(F.lit("TSDER"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(170).alias("category"), F.lit("RELATION_TO_GROUND").alias("label"), letter.alias("value"))
    return attributes.decode(rows).select("id", "major", "minor")


_VALUES = ("Y", "N", "12", "-9", "-999.99", "-35.5", "T", "S", "12045", "7 1/2S", "3 1/4N", "11AE", "9 3/4W", "E", "O", "U", "", "8", "D", "4 1/2W")
_ENTRIES = ", ".join(f"({k}, {c}, '{n}', '{attributes.kind_of(k, m)}', {major}, {m}, {attributes.OFFSETS.get(k, 0)}, {attributes.ELEVATIONS.get(k, (0, 0))[0]}, {attributes.ELEVATIONS.get(k, (0, 0))[1]}, {attributes.MONUMENTS.get(k, major)})" for k, c, major, n, m in attributes.FEATURES)
_LETTER_ROWS = ", ".join(f"({k}, '{t[0]}', {t[1:]})" for k, v in attributes.LETTERS.items() for t in v.split())
_BLANKS = ", ".join(f"'{b}'" for b in attributes.BLANKS)


@query("attr_decode_all", f"""with f(key, category, name, kind, major, minor, off, up, down, mon) as (values {_ENTRIES}), l(key, ch, code) as (values {_LETTER_ROWS}),
t as (select p_partkey as id, f.*, list_extract([{", ".join(f"'{v}'" for v in _VALUES)}], cast((p_partkey // 117 + p_size) % {len(_VALUES)} as int) + 1) as v from part join f on f.key = p_partkey % 117),
u as (select t.*, l.code, try_cast(nullif(regexp_extract(v, '^[-+]?[0-9]+'), '') as int) as n, try_cast(v as double) as r, v not in ({_BLANKS}) as good, regexp_extract(v, '^[-+]?[0-9]+ ([123]/[24])', 1) as q, regexp_extract(v, '^[-+]?[0-9]+(?: (?:1/4|1/2|3/4))? *(.?)', 1) as side from t left join l on l.key = t.key and l.ch = substr(v, 1, 1)),
w as (select *, case q when '1/4' then 2000 when '1/2' then 4000 when '3/4' then 6000 else 0 end as part from u)
select id, 0 as seq, cast(case kind when 'elevation' then case when r < 0 then down else up end when 'split' then 93 when 'monument' then mon when 'township' then case when side = 'S' then 303 else 302 end when 'range' then case when side = 'W' then 305 else 304 end else major end as int) as major,
  cast(case kind when 'flag' then minor when 'letter' then code when 'offset' then n + off when 'elevation' then round(abs(r)) when 'rounded' then round(r) when 'split' then floor(n / 1000.0) when 'township' then n + part when 'range' then n + part else n end as int) as minor
from w where case kind when 'flag' then v like 'Y%' when 'letter' then code is not null when 'elevation' then good and r is not null when 'rounded' then good and r is not null else good and n is not null end
union all select id, 1, 94, n % 1000 from w where kind = 'split' and good and n is not null""")
def attr_decode_all(spark, d):
    """Every entry of the dictionary with values of every shape."""
    k = F.col("p_partkey")
    entry = F.element_at(F.array(*(F.struct(F.lit(r[1]).alias("category"), F.lit(r[3]).alias("label")) for r in attributes.FEATURES)), (k % 117 + 1).cast("int"))
    value = F.element_at(F.array(*map(F.lit, _VALUES)), ((F.floor(k / 117) + F.col("p_size")) % len(_VALUES) + 1).cast("int"))
    rows = table(spark, d, "part").select(k.alias("id"), entry.alias("e"), value.alias("value")).select("id", "e.category", "e.label", "value")
    return attributes.decode(rows).select("id", "seq", "major", "minor")


@query("attr_township", "select p_partkey as id, case when p_partkey % 5 < 4 and p_partkey % 4 = 1 then 303 else 302 end as major, cast(p_size + case p_partkey % 5 when 1 then 2000 when 2 then 4000 when 3 then 6000 else 0 end as int) as minor from part")
def attr_township(spark, d):
    """Whole and broken townships, north, south, of another letter or none; an A behind the number means nothing."""
    k = F.col("p_partkey")
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    value = F.concat(F.col("p_size").cast("string"), pick(5, "", " 1/4", " 1/2", " 3/4", "A"), pick(4, "N", "S", "X", ""))
    rows = table(spark, d, "part").select(k.alias("id"), F.lit(300).alias("category"), F.lit("TOWNSHIP").alias("label"), value.alias("value"))
    return attributes.decode(rows).select("id", "major", "minor")


@query("attr_route", """with t as (select p_partkey as id, p_partkey % 6 as f, cast(p_size as int) as n from part)
select id, 0 as k, case f when 0 then 172 when 1 then 173 when 2 then 177 when 3 then 176 when 4 then 175 else 177 end as major, case f when 2 then 1 when 5 then 203 when 4 then 0 else n end as minor from t
union all select id, 1, case f when 1 then 177 when 2 then 174 when 3 then 177 end, case f when 1 then 1 when 2 then n when 3 then 2 end from t where f in (1, 2, 3)""")
def attr_route(spark, d):
    """Numbers alone, with a letter behind or in front, letters alone, and a jurisdiction without a number."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    value = F.element_at(F.array(F.concat(F.lit("I "), n), F.concat(F.lit("US "), n, F.lit("A")), F.concat(F.lit("SR A"), n), F.concat(F.lit("CR "), n, F.lit(" B")), F.lit("RR"), F.lit("BC")), (k % 6 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.posexplode(attributes.route(value)).alias("k", "r")).select("id", "k", "r.major", "r.minor")


@query("attr_route_type", "select p_partkey as id, 170 as major, list_extract([615, 616, 617, 619, 620, 621, 622], cast(p_partkey % 8 as int) + 1) as minor from part where p_partkey % 8 < 7")
def attr_route_type(spark, d):
    words = [w for w, _ in attributes.ROUTE_TYPES] + ["Other"]
    word = F.rpad(F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 8 + 1).cast("int")), 9, " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), attributes.route_type(word).alias("t")).filter("t is not null").select("id", "t.major", "t.minor")


@query("attr_main_codes", """with t as (select p_partkey as id, cast(p_size as int) as n, case when p_partkey % 2 = 0 then 1.0::double else -1.0::double end * p_size * 411.3::double as v from part)
select id, n % 9 * 50 + 20 as label_major, n * 7 as label_minor, case when v < 0 then 25 else 24 end as m_major, cast(round(abs(v)) as int) as m_minor,
  case when v < 0 then 23 when round(abs(v)) > 9999 then 21 else 22 end as f_major, cast(case when v >= 0 and round(abs(v)) > 9999 then round(abs(v)) - 10000 else round(abs(v)) end as int) as f_minor, n + 9 as c_major, n % 4 as c_minor from t""")
def attr_main_codes(spark, d):
    n = F.col("p_size").cast("int")
    v = F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(-1.0) * F.col("p_size") * 411.3
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), attributes.entity_label(F.format_string("%03d%04d", n % 9 * 50 + 20, n * 7)).alias("l"), attributes.elevation_metres(v).alias("m"), attributes.elevation_feet(v).alias("f"), attributes.coincident(n, n % 4).alias("c"))
    return t.select("id", *(F.col(f"{a}.{b}").alias(f"{name}_{b}") for a, name in (("l", "label"), ("m", "m"), ("f", "f"), ("c", "c")) for b in ("major", "minor")))


@query("theme_category", "select p_partkey as id, list_extract([90, 50, 20, 170, 200, 300, null], cast(p_partkey % 7 as int) + 1) as category from part")
def theme_category(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("BOUNDARIES", "Hydrography", "HYPSOGRAPHY", "ROADS AND TRAILS", "MANMADE FEATURES", "PUBLIC LAND SURVEYS", "other"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), attributes.theme_category(word).alias("category"))


# Topology

_TOPO = with_views("topology")


@query("node_line_list", f"{_TOPO}, e as (select start_node as node, id as a, 0 as b, id as s from topology union all select end_node, id, 1, -id from topology) select node, string_agg(cast(s as varchar), ' ' order by a, b) as lines from e group by 1")
def node_line_list(spark, d):
    return vector.node_lines(topology(spark, d)).select("node", F.array_join(F.col("lines").cast("array<string>"), " ").alias("lines"))


@query("area_line_list", f"{_TOPO}, e as (select right_area as area, id as a, id as s from topology where left_area <> right_area union all select left_area, id, -id from topology where left_area <> right_area) select area, string_agg(cast(s as varchar), ' ' order by a) as lines from e group by 1")
def area_line_list(spark, d):
    return vector.area_lines(topology(spark, d)).select("area", F.array_join(F.col("lines").cast("array<string>"), " ").alias("lines"))


@query("area_northmost", f"{_TOPO} select area, arg_max(id, (top, -id)) as id from (select left_area as area, id, top from topology union all select right_area, id, top from topology) group by 1")
def area_northmost(spark, d):
    return vector.northmost(topology(spark, d))


_NUMBERS = """n as (select c_custkey % 7 as file, cast(floor(c_custkey / 7) as bigint) + 1 as id from customer), kept as (select * from n where id % 10 <> 3), e as (select s_suppkey % 7 as file, s_suppkey as ne, row_number() over (partition by s_suppkey % 7 order by s_suppkey) as k from supplier),
m as (select file, max(id) as most from kept group by 1), c as (select file, count(*) as more from e group by 1), every as (select file, unnest(range(1, coalesce(most, 0) + coalesce(more, 0) + 1)) as id from m full join c using (file)),
g as (select file, id, row_number() over (partition by file order by id) as k from (select * from every except select * from kept)), r as (select e.file, e.ne, g.id as new_id from e join g using (file, k))"""


def _numbers(spark, d):
    k = F.col("c_custkey")
    ids = table(spark, d, "customer").select((k % 7).alias("file"), (F.floor(k / 7) + 1).cast("long").alias("id")).filter("id % 10 <> 3")
    return vector.renumbered(ids, table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("file"), F.col("s_suppkey").alias("ne")))


@query("node_renumber", f"with {_NUMBERS} select file, ne, new_id from r")
def node_renumber(spark, d):
    """Gaps among the node ids of seven files taken up, in order, by their entity nodes."""
    return _numbers(spark, d)


@query("node_repoint", f"with {_NUMBERS}, l as (select ps.o_orderkey as id, ps.o_custkey % 7 as file, case when o_orderkey % 2 = 0 then o_orderkey % 50 end as ne, o_custkey as node from orders ps) select l.file, l.id, coalesce(r.new_id, l.node) as start_node, coalesce(r.new_id, l.node) as end_node from l left join r on r.file = l.file and r.ne = l.ne")
def node_repoint(spark, d):
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("file"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50).alias("ne"), F.col("o_custkey").alias("start_node"), F.col("o_custkey").alias("end_node"))
    return vector.repointed(lines, _numbers(spark, d)).select("file", "id", "start_node", "end_node")


@query("poly_attr_chain", "select o_orderkey as id, n_regionkey || '.' || n_nationkey as attrs from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def poly_attr_chain(spark, d):
    """Areas of all orders to their polygon (customer) and its attribute record (nation)."""
    t = lambda n: table(spark, d, n)
    areas = t("orders").select(F.lit(0).alias("file"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("poly"))
    polys = t("customer").select(F.lit(0).alias("file"), F.col("c_custkey").alias("poly"), F.lit(0).alias("seq"), F.lit("AHYD").alias("module"), F.col("c_nationkey").alias("rcid"))
    attrs = t("nation").select(F.lit(0).alias("file"), F.lit("AHYD").alias("module"), F.col("n_nationkey").alias("rcid"), F.lit(0).alias("k"), F.col("n_regionkey").alias("major"), F.col("n_nationkey").alias("minor"))
    return vector.polygon_attributes(areas, polys, attrs).select("id", F.array_join(F.transform("attrs", lambda a: F.concat_ws(".", a["major"].cast("string"), a["minor"].cast("string"))), " ").alias("attrs"))


@query("record_id_fill", "select event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by event_id) as record from events")
def record_id_fill(spark, d):
    return sdts.forward_fill(table(spark, d, "events"), ("user_id",), ("event_id",), F.when(F.col("event_type") == "error", F.col("event_id")), "record").select("event_id", "record")


# Segments and pixels

_LP = with_views("line_pts") + ", s as (select line, pos, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from line_pts window w as (partition by line order by pos))"


@query("seg_pairs", f"{_LP} select line, pos, x1, y1, x2, y2 from s where x2 is not null")
def seg_pairs(spark, d):
    return vector.segments(line_pts(spark, d))


_CLIP = f"""{_LP}, c as (select *, x2 - x1 as dx, y2 - y1 as dy, x1 between 300 and 1500 and y1 between 200 and 1600 as in1, x2 between 300 and 1500 and y2 between 200 and 1600 as in2 from s where x2 is not null),
h as (select *, list_filter([
  case when dx <> 0 and 300 between least(x1, x2) and greatest(x1, x2) and y1 + dy * ((300 - x1) / nullif(dx, 0)) between 200 and 1600 then {{'x': 300.0::double, 'y': y1 + dy * ((300 - x1) / nullif(dx, 0))}} end,
  case when dx <> 0 and 1500 between least(x1, x2) and greatest(x1, x2) and y1 + dy * ((1500 - x1) / nullif(dx, 0)) between 200 and 1600 then {{'x': 1500.0::double, 'y': y1 + dy * ((1500 - x1) / nullif(dx, 0))}} end,
  case when dy <> 0 and 200 between least(y1, y2) and greatest(y1, y2) and x1 + dx * ((200 - y1) / nullif(dy, 0)) between 300 and 1500 then {{'x': x1 + dx * ((200 - y1) / nullif(dy, 0)), 'y': 200.0::double}} end,
  case when dy <> 0 and 1600 between least(y1, y2) and greatest(y1, y2) and x1 + dx * ((1600 - y1) / nullif(dy, 0)) between 300 and 1500 then {{'x': x1 + dx * ((1600 - y1) / nullif(dy, 0)), 'y': 1600.0::double}} end], lambda t: t is not null) as h from c)
select line, pos, round(case when in1 then x1 else h[1].x end, 6) as x1, round(case when in1 then y1 else h[1].y end, 6) as y1, round(case when in2 then x2 when in1 then h[1].x else h[2].x end, 6) as x2, round(case when in2 then y2 when in1 then h[1].y else h[2].y end, 6) as y2
from h where (in1 and in2) or (in1 <> in2 and len(h) >= 1) or (not in1 and not in2 and len(h) = 2)"""


@query("seg_clip", _CLIP)
def seg_clip(spark, d):
    return vector.clip(vector.segments(line_pts(spark, d)), 300, 200, 1500, 1600).select("line", "pos", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _short(spark, d):
    return vector.segments(line_pts(spark, d)).select("line", "pos", *(F.floor(F.col(c) / 100).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


_DRAW = f"""{_LP}, g as (select line, pos, cast(floor(x1 / 100) as int) as x1, cast(floor(y1 / 100) as int) as y1, cast(floor(x2 / 100) as int) as x2, cast(floor(y2 / 100) as int) as y2 from s where x2 is not null),
k as (select *, greatest(abs(x2 - x1), abs(y2 - y1)) as n, unnest(range(0, greatest(abs(x2 - x1), abs(y2 - y1)) + 1)) as k from g),
p as (select distinct line, pos, cast(case when k = n then x2 else round(x1 + k * ((x2 - x1)::double / n)) end as int) as x, cast(case when k = n then y2 else round(y1 + k * ((y2 - y1)::double / n)) end as int) as y from k)"""


@query("seg_raster", f"{_DRAW} select line, pos, x, y from p")
def seg_raster(spark, d):
    return vector.draw(_short(spark, d))


@query("pixel_composite", f"{_DRAW} select x, y, arg_max(cast(pos % 7 as int), line * 100 + pos) as color from p group by 1, 2")
def pixel_composite(spark, d):
    segs = _short(spark, d).select("x1", "y1", "x2", "y2", (F.col("line") * 100 + F.col("pos")).alias("z"), (F.col("pos") % 7).cast("int").alias("color"))
    return vector.paint(segs)


@query("flood_fill", f"""{CELLS.replace('with ', 'with recursive ', 1)}, px as (select cast(floor(i / 30.0) as bigint) as box, j as x, i as y, case when elev is null or elev % 3 = 0 then 1 else 0 end as color from grid_cells),
f as (select box, x, y from px where x = 50 and y % 30 = 15 and color <> 1 union select p.box, p.x, p.y from f join px p on p.box = f.box and abs(p.x - f.x) + abs(p.y - f.y) = 1 and p.color <> 1) select box, x, y from f""")
def flood_fill(spark, d):
    px = grid_cells(spark, d).select(F.floor(F.col("i") / 30).alias("box"), F.col("j").alias("x"), F.col("i").alias("y"), F.when(F.col("elev").isNull() | (F.col("elev") % 3 == 0), 1).otherwise(0).alias("color"))
    return vector.flood_fill(px, px.filter("x = 50 and y % 30 = 15").select("box", "x", "y"), 1)


@query("ring_assembly")
def ring_assembly(spark, d):
    """Squares of orders: four lines around each area, in shuffled order."""
    k = F.col("o_orderkey")
    area, side = F.floor(k / 4), k % 4
    node = lambda s: area * 4 + s % 4
    flip = k % 3 == 0
    lines = table(spark, d, "orders").select(area.alias("area"), k.alias("id"), F.when(flip, area).otherwise(-1).alias("left_area"), F.when(flip, -1).otherwise(area).alias("right_area"), F.when(flip, node(side + 1)).otherwise(node(side)).alias("start_node"), F.when(flip, node(side)).otherwise(node(side + 1)).alias("end_node"), F.col("o_totalprice").alias("top"))
    return vector.assemble_rings(lines)


_BOX4 = (35.0, -110.0, 40.0, -90.0)


@query("tile_overlap_dem", f"{PTS} select id from geo_points where not (lat >= 40 or lat + 1 <= 35 or lon >= -90 or lon + 1 <= -110)")
def tile_overlap_dem(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return geo_points(spark, d).filter(vector.overlaps(lat, lon, lat + 1, lon + 1, _BOX4, touching=False)).select("id")


@query("tile_overlap_dlg", f"{PTS} select id from geo_points where not (lat > 40 or lat + 1 < 35 or lon > -90 or lon + 1 < -110)")
def tile_overlap_dlg(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return geo_points(spark, d).filter(vector.overlaps(lat, lon, lat + 1, lon + 1, _BOX4, touching=True)).select("id")


@query("file_dispatch", "select p_partkey as id, case p_partkey % 4 when 0 then 'sdts_dem' when 1 then 'gtopo30' when 2 then 'classic' else 'sdts_dem' end as fmt, p_partkey % 4 = 3 as gz from part")
def file_dispatch(spark, d):
    from ..sources.dispatch import format_of

    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, "x/1107CEL0.DDF").when(k % 4 == 1, "w100n40.hdr").when(k % 4 == 2, "bozeman.dem").otherwise("x/1107CEL0.ddf.gz")
    return table(spark, d, "part").select(k.alias("id"), format_of(path).alias("t")).select("id", "t.fmt", "t.gz")
