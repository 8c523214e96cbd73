"""Registered queries of the image operators and of SDTS transfers, over tiles and transfers made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, geodesy
from ..operators import grid, image, vector
from ..sources import sdts, sinks
from .carriers import geo_points, grid_cells, table, with_views
from .queries import CELLS, PTS, forward_sql
from .registry import query

FRAME = image.Frame((40.2, -110.4, 42.9, -107.1), 160, 120)
S, N, W, E = FRAME.south, FRAME.north, FRAME.west, FRAME.east

# Tiles of 30 rows of the carrier grid, each of a degree, the next ones a little further on.
_TILES = f"{CELLS}, tc as (select cast(floor(i / 30.0) as int) as tile, i % 30 as i, j, elev from grid_cells), tiles as (select distinct tile, tile as seq, 40.0::double + tile % 4 * 0.8 as sw_lat, -111.0::double + tile % 5 * 0.9 as sw_lon, 41.0::double + tile % 4 * 0.8 as ne_lat, -110.0::double + tile % 5 * 0.9 as ne_lon, 30 as rows, 100 as cols from tc)"
_WIN = f"""{_TILES}, w1 as (select *, greatest(sw_lat, {S}) as lat1, greatest(sw_lon, {W}) as lon1, least(ne_lat, {N}) as lat2, least(ne_lon, {E}) as lon2 from tiles where sw_lat < {N} and ne_lat > {S} and sw_lon < {E} and ne_lon > {W}),
win as (select *, cast(round((cols - 1) * (lon2 - lon1) / (ne_lon - sw_lon)) as int) as w, cast(round((rows - 1) * (lat2 - lat1) / (ne_lat - sw_lat)) as int) as h, cast(round((cols - 1) * (lon1 - sw_lon) / (ne_lon - sw_lon)) as int) as x0,
  rows - 1 - cast(round((rows - 1) * (lat2 - sw_lat) / (ne_lat - sw_lat)) as int) as y0, cast(round({FRAME.width} * (lon1 - {W}) / ({E} - {W})) as int) as x_low, cast(round({FRAME.width + 1} * (lon2 - {W}) / ({E} - {W})) as int) as x_high,
  {FRAME.height} - cast(round({FRAME.height} * (lat2 - {S}) / ({N} - {S})) as int) as y_low, {FRAME.height + 1} - cast(round({FRAME.height} * (lat1 - {S}) / ({N} - {S})) as int) as y_high from w1),
px as (select win.*, a.i, b.j from win, lateral (select unnest(range(y_low, y_high)) as i) a, lateral (select unnest(range(x_low, x_high)) as j) b)"""
_HITS = f"""{_WIN}, hits as (select tile, seq, i, j, y0 + cast(coalesce(round((h * (i - y_low))::double / nullif(y_high - 1 - y_low, 0)), 0) as int) as k, x0 + cast(coalesce(round((w * (j - x_low))::double / nullif(x_high - 1 - x_low, 0)), 0) as int) as l from px)"""


def _cells(spark, d) -> DataFrame:
    return grid_cells(spark, d).select(F.floor(F.col("i") / 30).cast("int").alias("tile"), (F.col("i") % 30).alias("i"), "j", "elev")


def _tiles(spark, d) -> DataFrame:
    t = F.col("tile")
    lat, lon = 40.0 + t % 4 * 0.8, -111.0 + t % 5 * 0.9
    return _cells(spark, d).select("tile").distinct().select("tile", t.alias("seq"), lat.alias("sw_lat"), lon.alias("sw_lon"), (41.0 + t % 4 * 0.8).alias("ne_lat"), (-110.0 + t % 5 * 0.9).alias("ne_lon"), F.lit(30).alias("rows"), F.lit(100).alias("cols"))


@query("map_window", f"{_WIN} select tile, w, h, x0, y0, x_low, x_high, y_low, y_high from win")
def map_window(spark, d):
    return image.windows(_tiles(spark, d), FRAME).select("tile", "w", "h", "x0", "y0", "x_low", "x_high", "y_low", "y_high")


@query("map_resample", f"{_HITS} select h.i, h.j, arg_max(c.elev, h.seq) as elev from hits h join tc c on c.tile = h.tile and c.i = h.k and c.j = h.l where c.elev is not null group by 1, 2")
def map_resample(spark, d):
    hits = image.fetch(image.sources(image.windows(_tiles(spark, d), FRAME)), _cells(spark, d))
    return grid.mosaic(hits)


@query("data_smooth", f"""{_HITS}, sm as (select a.tile, a.i, a.j, cast(round(sum(b.elev)::double / count(b.elev)) as int) as elev from tc a join tc b on b.tile = a.tile and abs(b.i - a.i) <= 2 and abs(b.j - a.j) <= 2 where a.elev is not null group by 1, 2, 3)
select h.tile, h.i, h.j, c.elev from hits h join sm c on c.tile = h.tile and c.i = h.k and c.j = h.l""")
def data_smooth(spark, d):
    return image.fetch(image.sources(image.windows(_tiles(spark, d), FRAME)), _cells(spark, d), radius=2).select("tile", "i", "j", "elev")


_UTM = f"""{_WIN}, um as (select tile, 'x' as _, rows, cols, 30.0::double as res, i, j, lat2 - coalesce((i - y_low) * (lat2 - lat1) / nullif(y_high - y_low - 1, 0), 0) as plat, lon1 + coalesce((j - x_low) * (lon2 - lon1) / nullif(x_high - x_low - 1, 0), 0) as plon, 400000.0::double + tile % 5 * 60000 as x_min, 700000.0::double + tile % 5 * 60000 as x_max, 4430000.0::double + tile % 4 * 80000 as y_min, 4580000.0::double + tile % 4 * 80000 as y_max from px),
ut as (select *, round_even(utm_x / res, 0) * res as ux, round_even(utm_y / res, 0) * res as uy from {forward_sql('um', 'plat', 'plon')}),
uh as (select tile, i, j, rows - 1 - cast(round((rows - 1) * (uy - y_min) / (y_max - y_min)) as int) as k, cast(round((cols - 1) * (ux - x_min) / (x_max - x_min)) as int) as l, rows, cols from ut)
select tile, i, j, k, l from uh where k between 0 and rows - 1 and l between 0 and cols - 1"""


@query("resample_utm", _UTM)
def resample_utm(spark, d):
    t = F.col("tile")
    west, south = 400000.0 + t % 5 * 60000, 4430000.0 + t % 4 * 80000
    tiles = _tiles(spark, d).withColumns({"x_res": F.lit(30.0), "y_res": F.lit(30.0), "x_min": west, "x_max": west + 300000.0, "y_min": south, "y_max": south + 150000.0})
    return image.sources_utm(image.windows(tiles, FRAME)).select("tile", "i", "j", "k", "l")


_IX, _IY = FRAME.width / (E - W), FRAME.height / (N - S)


@query("map_resolutions", f"""{_TILES}, v as (select tile, (cols - 1) * (1 + tile % 3 * 4) / (ne_lon - sw_lon) as rx, (rows - 1) * (1 + tile % 3 * 4) / (ne_lat - sw_lat) as ry from tiles)
select tile, {1.5 * _IY} < ry or {1.5 * _IX} < rx as smooth_data, case when {1.5 * _IY} < ry or {1.5 * _IX} < rx then greatest(1, cast(round(least(10.0::double, ry / {_IY} - 1, rx / {_IX} - 1)) as int)) else 0 end as radius, 1.05::double * ry < {_IY} or 1.05::double * rx < {_IX} as smooth_image from v""")
def map_resolutions(spark, d):
    tiles = _tiles(spark, d).withColumns({c: (F.col(c) - 1) * (1 + F.col("tile") % 3 * 4) + 1 for c in ("rows", "cols")})
    return image.resolutions(tiles, FRAME).select("tile", "smooth_data", "radius", "smooth_image")


@query("map_image_radius", f"""{_TILES}, v as (select seq, (cols - 1) / (ne_lon - sw_lon) as rx, (rows - 1) / (ne_lat - sw_lat) as ry from tiles)
select bool_or(1.05::double * ry < {_IY} or 1.05::double * rx < {_IX}) as smooth, case when bool_or(1.05::double * ry < {_IY} or 1.05::double * rx < {_IX}) then greatest(1, cast(round(least(10.0::double, {_IY} / arg_max(ry, seq), {_IX} / arg_max(rx, seq))) as int)) else 0 end as radius from v""")
def map_image_radius(spark, d):
    return image.image_radius(image.resolutions(_tiles(spark, d), FRAME), FRAME)


@query("map_image")
def map_image(spark, d):
    """The whole chain, from tiles to colours."""
    return image.render(_tiles(spark, d), _cells(spark, d), FRAME)


@query("map_blank", f"select cast(a.range as int) as i, cast(b.range as int) as j from range({FRAME.height + 1}) a, range({FRAME.width + 1}) b")
def map_blank(spark, d):
    return image.blank(spark, FRAME)


@query("pixel_latlon", f"{CELLS} select i, j, round({S} + ({N} - {S}) * ({FRAME.height} - i) / {FRAME.height}.0::double, 9) as lat, round({W} + ({E} - {W}) * j / {FRAME.width}.0::double, 9) as lon from grid_cells")
def pixel_latlon(spark, d):
    lat, lon = image.to_latlon(F.col("i"), F.col("j"), FRAME)
    return grid_cells(spark, d).select("i", "j", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("round_half_even", f"{PTS} select id, round_even(lat * 10, 0) as r from geo_points")
def round_half_even(spark, d):
    return geo_points(spark, d).select("id", F.rint(F.col("lat") * 10).alias("r"))


@query("metres_per_degree", f"{CELLS} select distinct i, round(sqrt(2.0::double / 2880000) * sqrt(pow(110950.0::double, 2) + pow(111320.0::double * cos(radians(60.0::double - i / 1200.0::double)), 2)), 6) as metres from grid_cells")
def metres_per_degree(spark, d):
    return grid_cells(spark, d).select("i").distinct().select("i", F.round(grid.row_spacing(F.col("i"), 60.0, 1.0, 1.0, 1200, 1200), 6).alias("metres"))


def _on_datum(datum: str, src: str) -> str:
    sql = forward_sql(src)
    for a, b in zip(geodesy.DATUMS["nad27"], geodesy.DATUMS[datum], strict=True):
        sql = sql.replace(repr(a), repr(b))
    return sql


def _register_south(datum: str) -> None:
    @query(f"utm_forward_{datum}", f"{PTS}, south as (select id, -lat as lat, lon from geo_points) select id, round(utm_x, 3) as utm_x, round(utm_y + 10000000, 3) as utm_y, -utm_zone as utm_zone from {_on_datum(datum, 'south')}")
    def run(spark, d):
        """South of the equator, on another datum."""
        return geodesy.add_utm(geo_points(spark, d).withColumn("lat", -F.col("lat")), "lat", "lon", datum).select("id", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"), "utm_zone")


for _datum in ("nad83", "wgs84"):
    _register_south(_datum)


@query("utm_by_datum", f"{PTS}, r as (" + " union all ".join(f"select id, utm_x, utm_y from {_on_datum(n, 'geo_points')} where id % 4 in ({k})" for n, k in (("nad27", "0, 3"), ("nad83", "1"), ("wgs84", "2"))) + ") select id, round(utm_x, 3) as utm_x, round(utm_y, 3) as utm_y from r")
def utm_by_datum(spark, d):
    """A datum per row; a name of none stands for the first."""
    name = F.element_at(F.array(*map(F.lit, ("nad27", "NAD83", "wgs84", "?"))), (F.col("id") % 4 + 1).cast("int"))
    got = geodesy.add_utm_by(geo_points(spark, d).withColumn("datum", name), "lat", "lon", "datum")
    return got.select("id", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"))


# Labels, boxes, ticks, colours

@query("graph_box", f"{PTS}, b as (select id, cast(-1 + round((lon - {W}) * {FRAME.width} / ({E} - {W})) as int) as x1, cast({FRAME.height - 1} - round((lat + 1 - {S}) * {FRAME.height} / ({N} - {S})) as int) as y1, cast(-1 + round((lon + 1 - {W}) * {FRAME.width} / ({E} - {W})) as int) as x2, cast({FRAME.height - 1} - round((lat - {S}) * {FRAME.height} / ({N} - {S})) as int) as y2 from geo_points) select id, greatest(x1, -1) as x_low, greatest(y1, -1) as y_low, least(x2, {FRAME.width - 1}) as x_high, least(y2, {FRAME.height - 1}) as y_high from b")
def graph_box(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return geo_points(spark, d).select("id", image.graph_box(lat, lon, lat + 1, lon + 1, FRAME).alias("b")).select("id", "b.*")


@query("label_place", f"{PTS}, p as (select id, cast(id % 170 as int) as x, cast(id * 7 % 125 as int) as y, length(name) as n from geo_points) select id, cast(case when x + 5 + n * 5 >= {FRAME.width} then x - 5 - n * 5 else x + 5 end as int) as x, cast(case when y + 3 >= {FRAME.height} then {FRAME.height - 8} when y - 4 < 0 then 0 else y - 4 end as int) as y from p")
def label_place(spark, d):
    place = image.label_place((F.col("id") % 170).cast("int"), (F.col("id") * 7 % 125).cast("int"), F.length("name"), FRAME)
    return geo_points(spark, d).select("id", place.alias("p")).select("id", "p.x", "p.y")


@query("cursor_pixels", f"""{CELLS}, px as (select j as x, i as y, case when elev is null or elev % 7 = 0 then {color.WHITE} else 3 end as color from grid_cells), pt as (select p_partkey as id, cast(p_partkey * 13 % 100 as int) as x, cast(p_partkey * 7 % 150 as int) as y from part),
o as (select range as a, 0 as b from range(-3, 4) union select 0, range from range(-3, 4)), u as (select pt.id, px.x, px.y, px.color as was from pt, o, px where px.x = pt.x + o.a and px.y = pt.y + o.b)
select id, x, y, case when bool_or(was = {color.WHITE}) over (partition by id) then {color.BLACK} else {color.WHITE} end as color from u""")
def cursor_pixels(spark, d):
    px = grid_cells(spark, d).select(F.col("j").alias("x"), F.col("i").alias("y"), F.when(F.col("elev").isNull() | (F.col("elev") % 7 == 0), color.WHITE).otherwise(3).alias("color"))
    k = F.col("p_partkey")
    return image.cursors(table(spark, d, "part").select(k.alias("id"), (k * 13 % 100).cast("int").alias("x"), (k * 7 % 150).cast("int").alias("y")), px)


@query("shade_dim", "select cast(range as int) as idx, cast(range + ((16 - (range & 15)) >> 1) as int) as dim from range(256)")
def shade_dim(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("idx")).select("idx", color.dimmed(F.col("idx")).alias("dim"))


_ALL = ", ".join(f"({p}, {k}, {r}, {g}, {b})" for p, rows in color.PALETTES.items() for k, (r, g, b) in enumerate((*rows, (0, 0, 0), (0, 0, 0))))


@query("shade_ramp_palettes", f"with b(p, k, r0, g0, b0) as (values {_ALL}), j as (select cast(range as int) as j from range(16)) select p as palette, cast(k * 16 + j as int) as idx, " + ", ".join(f"cast({c}0 - round(j * 0.5::double * {c}0 / 15.0::double) as int) as {c}" for c in "rgb") + " from b, j")
def shade_ramp_palettes(spark, d):
    out = None
    for p in color.PALETTES:
        one = color.shade_ramp(spark, p, 0.5).withColumn("palette", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


@query("number_general", f"{PTS} select id, printf('%.10g', lat / 3) as a, printf('%.5g', lon * 36.7713) as b, printf('%.6g', lat) as c from geo_points")
def number_general(spark, d):
    g = image.general
    return geo_points(spark, d).select("id", g(F.col("lat") / 3, 10).alias("a"), g(F.col("lon") * 36.7713, 5).alias("b"), g(F.col("lat"), 6).alias("c"))


@query("elevation_label", f"{CELLS}, c as (select * from grid_cells where elev is not null), a as (select * from c order by elev, i, j limit 1), b as (select * from c order by elev desc, i, j limit 1) select printf('Elevations: %dm (%dft) at %.5g%s %.6g%s, %dm (%dft) at %.5g%s %.6g%s', " + ", ".join(f"{t}.elev, cast(round({t}.elev * 3.28084::double) as int), abs({S} + ({N} - {S}) * ({FRAME.height} - {t}.i) / {FRAME.height}.0::double), 'N', abs({W} + ({E} - {W}) * {t}.j / {FRAME.width}.0::double), 'W'" for t in "ab") + ") as label from a, b")
def elevation_label(spark, d):
    return image.elevation_label(grid.extremes(grid_cells(spark, d)), FRAME)


@query("map_ticks", f"""select 'lat' as side, cast({image.TOP - 1 + FRAME.height} - round({FRAME.height} * (k * 0.1::double - {S}) / ({N} - {S})) as int) as at, case when k % 5 = 0 then 6 else 4 end as width, case when k % 5 = 0 then printf('%.2fN', k / 10.0::double) end as label from (select range as k from range(402, 430))
union all select 'lon', cast({image.LEFT - 1} + round({FRAME.width} * (k * 0.1::double - ({W})) / ({E} - {W})) as int), case when k % 10 = 0 then 6 else 4 end, case when k % 10 = 0 then printf('%.2fW', abs(k / 10.0::double)) end from (select range as k from range(-1104, -1070))""")
def map_ticks(spark, d):
    return image.ticks(spark, FRAME)


@query("map_legend", f"""with b as (select range as i from range({image.CHART_WIDTH})), m as (select range as k from range({image.CHART_WIDTH // 16 + 1}))
select cast(i + {image.LEFT + FRAME.width // 2 - image.CHART_WIDTH // 2} as int) as x, cast({image.TOP + FRAME.height + 40 - 18} + r.range as int) as y, cast(floor(i / 16) * 16 + 3 as int) as color from b, range(16) r
union all select cast(k * 16 + {image.LEFT + FRAME.width // 2 - image.CHART_WIDTH // 2} as int), cast({image.TOP + FRAME.height + 40 - 2} + r.range as int), {color.BLACK} from m, range(3) r""")
def map_legend(spark, d):
    return image.legend_pixels(spark, FRAME)


_HIGH, _WIDE = FRAME.height + image.TOP + image.BOTTOM, FRAME.width + image.LEFT + image.RIGHT


@query("map_border", f"select cast(a.range as int) as x, cast(b.range as int) as y, {color.WHITE} as color from range({_WIDE}) a, range({_HIGH}) b where not (a.range between {image.LEFT} and {image.LEFT + FRAME.width - 1} and b.range between {image.TOP} and {image.TOP + FRAME.height - 1})")
def map_border(spark, d):
    return image.border_pixels(spark, FRAME)


@query("map_text", """with t as (select p_partkey as id, cast(p_partkey % 200 as int) as x, cast(p_partkey % 90 as int) as y, 'A' || (p_partkey % 10) as txt from part where p_partkey < 300),
c as (select t.id, t.x, t.y, cast(n.range as int) as n, ascii(substr(txt, cast(n.range as int) + 1, 1)) as code from t, range(2) n)
select id, cast(x + n * 5 + k.range as int) as x, cast(y + r.range as int) as y, 243 as color from c, range(8) r, range(5) k where ((code * 31 + r.range * 7) >> (4 - k.range)) & 1 = 1""")
def map_text(spark, d):
    """Two characters each, in a font whose rows come of a rule."""
    glyphs = spark.range(256).select(F.col("id").cast("int").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row")).withColumn("bits", (F.col("code") * 31 + F.col("row") * 7).bitwiseAND(F.lit(31)))
    k = F.col("p_partkey")
    labels = table(spark, d, "part").filter("p_partkey < 300").select(k.alias("id"), F.concat(F.lit("A"), (k % 10).cast("string")).alias("text"), (k % 200).cast("int").alias("x"), (k % 90).cast("int").alias("y"))
    return image.text_pixels(labels, glyphs, (5, 8), color.BLACK)


@query("area_fill_rules", "select p_partkey as id from part where p_size % 3 > 0 and ((p_partkey % 7 = 2 and p_size % 3 >= 1) or p_partkey = 77)")
def area_fill_rules(spark, d):
    k = F.col("p_partkey")
    one = F.struct((90 + k % 7).cast("int").alias("major"), F.lit(100).alias("minor"))
    areas = table(spark, d, "part").select(k.alias("id"), F.when(F.col("p_size") % 3 > 0, F.array(one)).otherwise(F.expr("cast(array() as array<struct<major:int,minor:int>>)")).alias("attrs"))
    return vector.areas_to_fill(areas, (("A", 92, -1), ("A", 10000, 77), ("L", 93, -1))).select("id")


@query("grid_height_range", f"{CELLS} select min(greatest(elev, 0)) as lo, max(greatest(elev, 0)) as hi from grid_cells where elev is not null")
def grid_height_range(spark, d):
    return grid.height_range(grid_cells(spark, d))


@query("map_name", "select case when count(*) = 1 then any_value(c_name) else 'Data from multiple DEM files' end as name from customer")
def map_name(spark, d):
    return image.map_name(table(spark, d, "customer").select(F.col("c_name").alias("title")))


# SDTS transfers made of the driver's tables: bytes as a file would hold them

def _subs(df: DataFrame, file, module: str, rec, items) -> DataFrame:
    """A row per item ``(seq, tag, label, format, value)`` of each row; a null value is none."""
    each = F.array(*(F.struct(F.lit(n).cast("int").alias("seq") if isinstance(n, int) else n.cast("int").alias("seq"), F.lit(tag).alias("tag"), F.lit(label).alias("label"), F.lit(fmt).alias("format"), v.alias("value")) for n, tag, label, fmt, v in items))
    return df.select(file.cast("string").alias("file"), F.lit(module).alias("module"), rec.cast("int").alias("rec"), F.explode(each).alias("s")).select("file", "module", "rec", "s.*").filter("value is not null")


def _bytes(v):
    return F.encode(v.cast("string"), "utf-8")


def _big(v, size: int):
    return F.unhex(F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0"))


def _union(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for x in dfs[1:]:
        out = out.unionByName(x)
    return out


_META = (("IDEN", "IDEN", "TITL", "A", "concat('QUAD ', s_suppkey)"), ("DQPA", "DQPA", "RCID", "I", "1"), ("DQPA", "DQPA", "COMT", "A", "concat('DEM LEVEL ', s_suppkey % 4)"),
         ("XREF", "XREF", "RSNM", "A", "element_at(array('GEO', 'UTM', 'SPCS', 'odd'), cast(s_suppkey % 4 + 1 as int))"), ("XREF", "XREF", "ZONE", "I", "s_suppkey % 60 + 1"), ("XREF", "XREF", "HDAT", "A", "if(s_suppkey % 2 = 0, 'NAS', 'WGE')"), ("XREF", "VATT", "VDAT", "A", "'NGVD'"),
         ("IREF", "IREF", "XHRS", "R", "'30.0'"), ("IREF", "IREF", "YHRS", "R", "'30.0'"), ("IREF", "IREF", "SFAX", "R", "'0.01'"), ("IREF", "IREF", "SFAY", "R", "'0.01'"), ("IREF", "IREF", "XORG", "R", "'500000'"), ("IREF", "IREF", "YORG", "R", "'4000000'"),
         ("DDSH", "DDSH", "UNIT", "A", "if(s_suppkey % 3 = 0, 'FEET', 'METERS')"), ("DDSH", "DDSH", "PREC", "R", "'1'"), ("LDEF", "LDEF", "NROW", "I", "30"), ("LDEF", "LDEF", "NCOL", "I", "100"), ("RSDF", "RSDF", "OBRP", "A", "'G2'"))
_META_SQL = "select s_suppkey as file, 'QUAD ' || s_suppkey as title, cast(s_suppkey % 4 as int) as level, case s_suppkey % 4 when 0 then 0 when 1 then 1 when 2 then 2 else -1 end as plane_ref, cast(s_suppkey % 60 + 1 as int) as zone, case when s_suppkey % 2 = 0 then 1 else 3 end as h_datum, 2 as v_datum, case when s_suppkey % 3 = 0 then 1 else 2 end as elev_units, -32767 as void_fill, -32766 as edge_fill, 100.0::double + s_suppkey as sw_x, 100.0::double + s_suppkey + 3 as se_x, 500000 + ceil((s_suppkey * 7 * 0.01::double) / 30.0::double) * 30 + 20 as x_first, floor((4000000 + s_suppkey * 11 * 0.01::double) / 30.0::double) * 30 as y_first, s_suppkey % 9 = 0 as rejected from supplier"


def _dem_subfields(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k, rec = F.col("s_suppkey"), F.lit(1)
    modules = list(dict.fromkeys(m for m, *_ in _META))
    one = [_subs(s, k, m, rec, [(n, tag, label, fmt, _bytes(F.expr(v))) for n, (mm, tag, label, fmt, v) in enumerate(_META) if mm == m]) for m in modules]
    corner = [(2 * c + n, "DMSA", axis, "R", _bytes(v + k + c)) for c in range(4) for n, (axis, v) in enumerate((("X", F.lit(100.0)), ("Y", F.lit(200.0))))]
    dom = [(c, "DDOM", "DVAL", "I", F.when(F.lit(c < 3) | (k % 9 != 0), _bytes(F.lit(v)))) for c, v in enumerate(("-32767", "-32766", "10", "900"))]
    return _union(*one, _subs(s, k, "SPDM", rec, corner), _subs(s, k, "DDOM", rec, dom), _subs(s, k, "RSDF", rec, [(50, "SADR", "X", "B(32)", _big(k * 7, 4)), (51, "SADR", "Y", "B(32)", _big(k * 11, 4))]))


@query("sdts_dem_meta", _META_SQL.replace("500000 + ceil((s_suppkey * 7 * 0.01::double) / 30.0::double) * 30 + 20", "ceil((500000 + s_suppkey * 7 * 0.01::double) / 30.0::double) * 30"))
def sdts_dem_meta(spark, d):
    meta = sdts.dem_meta(_dem_subfields(spark, d))
    bad = sdts.rejects(meta).select(F.col("source").alias("file"), F.lit(True).alias("rejected"))
    cols = ("title", "level", "plane_ref", "zone", "h_datum", "v_datum", "elev_units", "void_fill", "edge_fill", "sw_x", "se_x", "x_first", "y_first")
    return meta.join(bad, "file", "left").select(F.col("file").cast("long").alias("file"), *cols, F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query("sdts_dem_cells", f"{CELLS}, v as (select cast(floor(i / 30.0) as int) as tile, i % 30 as i, j, coalesce(elev, -32766) as v from grid_cells) select tile as file, i, j, cast(case when v = -32766 or v = 32767 then null when v = 100 then 0 when tile % 2 = 0 then round(v * 0.3048::double) else v end as int) as elev from v")
def sdts_dem_cells(spark, d):
    """Tiles as cell modules of two-byte numbers, every other one in feet; 100 stands for a void."""
    c = _cells(spark, d)
    sub = _subs(c, F.col("tile"), "CEL0", F.col("i") + 1, [(F.col("j") + 5, "CVLS", "ELEVATION", "B(16)", _big(F.coalesce("elev", F.lit(-32766)), 2))])
    meta = c.select(F.col("tile").cast("string").alias("file"), F.lit(100).alias("void_fill"), F.lit(-32766).alias("edge_fill"), F.when(F.col("tile") % 2 == 0, 1).otherwise(2).alias("elev_units"), F.lit(30).alias("rows"), F.lit(100).alias("cols")).distinct()
    return sdts.dem_cells(sub, meta).select(F.col("file").cast("int").alias("file"), "i", "j", "elev")


@query("sdts_real_cells", "select p_partkey as id, cast(p_retailprice as float)::double as v from part")
def sdts_real_cells(spark, d):
    """Four-byte reals, as bits: sign, exponent and fraction of the price."""
    v = F.col("p_retailprice").cast("float").cast("double")
    e = F.floor(F.log2(v)).cast("long")
    bits = F.shiftleft(e + 127, 23) + F.round((v / F.pow(F.lit(2.0), e.cast("double")) - 1) * (1 << 23)).cast("long")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), sdts.real32(_big(bits, 4)).alias("v"))


def _graph_subfields(spark, d) -> DataFrame:
    """Orders as lines with two points and a link, customers as nodes, nations as areas with polygons, regions as entity nodes."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    files = spark.range(3).select(F.col("id").alias("file"))
    k, ck, nk, rk = (F.col(x) for x in ("o_orderkey", "c_custkey", "n_nationkey", "r_regionkey"))

    def items(*rows):
        return [(seq, *row) for seq, row in enumerate(rows)]

    def xy(x, y):
        return [("SADR", "X", "B(32)", _big(x, 4)), ("SADR", "Y", "B(32)", _big(y, 4))]

    num = lambda tag, v: (tag, "RCID", "I", _bytes(v))
    word = lambda tag, label, v: (tag, label, "A", F.encode(v, "utf-8"))
    parts = [
        _subs(o, k % 3, "LE01", k + 1, items(num("LINE", k), word("ATID", "MODN", F.when(k % 5 == 0, "AHYF").otherwise("ARDF")), num("ATID", k % 25), num("PIDL", k % 25 + 2), num("PIDR", k % 7 + 2), num("SNID", F.col("o_custkey")), num("ENID", F.col("o_custkey") * 7 % 1500), *xy(k - 500, k * 2), *xy(k + 9, -k))),
        _subs(c, ck % 3, "NO01", ck + 1, items(num("PNTS", ck), *xy(ck * 3, -ck))),
        _subs(r, rk % 3, "NE01", rk + 1, items(num("PNTS", rk + 90000), num("ARID", rk + 2), *xy(rk, rk))),
        _subs(n, nk % 3, "NA01", nk + 1, items(num("PNTS", nk + 2), num("ARID", nk), *xy(nk, nk * 5))),
        _subs(n, nk % 3, "PC01", nk + 1, items(num("POLY", nk), word("ATID", "MODN", F.lit("AHYF")), num("ATID", nk), word("ATID", "MODN", F.lit("odd")), num("ATID", nk))),
        _subs(files, F.col("file"), "IREF", F.lit(1), [(s, "IREF", label, "R", _bytes(F.lit(v))) for s, (label, v) in enumerate((("SFAX", "0.5"), ("SFAY", "0.25"), ("XORG", "1000"), ("YORG", "2000")))]),
        _subs(files, F.col("file"), "NP01", F.lit(1), items(num("PNTS", F.lit(1)), *xy(F.lit(-8), F.lit(-16)))),
    ]
    for rec, name, theme in ((1, "AHYF", "HYDROGRAPHY"), (2, "ARDF", "ROADS AND TRAILS"), (3, "LE01", "")):
        parts.append(_subs(files, F.col("file"), "CATS", F.lit(rec), items(word("CATS", "NAME", F.lit(name)), word("CATS", "THEM", F.lit(theme)))))
    every = n.select(nk, F.explode(F.array(*map(F.lit, range(3)))).alias("file"))
    parts.append(_subs(every, F.col("file"), "AHYF", nk + 1, items(num("ATPR", nk), word("ATTP", "ENTITY_LABEL", F.format_string("050%04d", (400 + nk).cast("int"))), word("ATTP", "INTERMITTENT", F.when(nk % 2 == 0, "Y").otherwise("N")))))
    parts.append(_subs(every, F.col("file"), "ARDF", nk + 1, items(num("ATPR", nk), word("ATTP", "ROUTE_NUMBER", F.concat(F.lit("US "), nk.cast("string"), F.lit("B"))), word("ATTP", "LANES", (nk % 4).cast("string")))))
    return _union(*parts)


@query("sdts_lines", """select cast(o_orderkey % 3 as varchar) as file, o_orderkey as id, o_custkey as start_node, o_custkey * 7 % 1500 as end_node, o_orderkey % 25 + 2 as left_area, o_orderkey % 7 + 2 as right_area, 2 as n, (o_orderkey - 500) * 0.5::double + 1000 as x0, o_orderkey * 2 * 0.25::double + 2000 as y0, (o_orderkey + 9) * 0.5::double + 1000 as x1, -o_orderkey * 0.25::double + 2000 as y1 from orders
union all select cast(r_regionkey % 3 as varchar), r_regionkey + 90000, r_regionkey + 90000, r_regionkey + 90000, r_regionkey + 2, r_regionkey + 2, 2, r_regionkey * 0.5::double + 1000, r_regionkey * 0.25::double + 2000, r_regionkey * 0.5::double + 1000, r_regionkey * 0.25::double + 2000 from region""")
def sdts_lines(spark, d):
    p = lambda k: F.element_at("pts", k)
    return sdts.lines(_graph_subfields(spark, d)).select("file", "id", "start_node", "end_node", "left_area", "right_area", F.size("pts").alias("n"), p(1)["x"].alias("x0"), p(1)["y"].alias("y0"), p(2)["x"].alias("x1"), p(2)["y"].alias("y1"))


@query("sdts_nodes", "select cast(c_custkey % 3 as varchar) as file, 'NO' as kind, c_custkey as id, c_custkey * 3 * 0.5::double + 1000 as x, -c_custkey * 0.25::double + 2000 as y from customer union all select cast(r_regionkey % 3 as varchar), 'NE', r_regionkey + 90000, r_regionkey * 0.5::double + 1000, r_regionkey * 0.25::double + 2000 from region")
def sdts_nodes(spark, d):
    return sdts.nodes(_graph_subfields(spark, d))


@query("sdts_areas", "select cast(range as varchar) as file, 1 as id, null as poly, 996.0::double as x, 1996.0::double as y from range(3) union all select cast(n_nationkey % 3 as varchar), n_nationkey + 2, n_nationkey, n_nationkey * 0.5::double + 1000, n_nationkey * 5 * 0.25::double + 2000 from nation")
def sdts_areas(spark, d):
    return sdts.areas(_graph_subfields(spark, d))


_ATTRS = """a as (select cast(f.range as varchar) as file, 'AHYF' as module, n_nationkey as rcid, 0 as k, 50 as major, 400 + n_nationkey as minor from nation, range(3) f
union all select cast(f.range as varchar), 'AHYF', n_nationkey, 1, 50, 610 from nation, range(3) f where n_nationkey % 2 = 0
union all select cast(f.range as varchar), 'ARDF', n_nationkey, 0, 173, n_nationkey from nation, range(3) f union all select cast(f.range as varchar), 'ARDF', n_nationkey, 1, 177, 2 from nation, range(3) f
union all select cast(f.range as varchar), 'ARDF', n_nationkey, 2, 171, n_nationkey % 4 from nation, range(3) f)"""


def _sdts_attrs(sub):
    return sdts.attributes(sub, sdts.themes(sub))


@query("sdts_attrs", f"with {_ATTRS} select file, module, rcid, k, cast(major as int) as major, cast(minor as int) as minor from a")
def sdts_attrs(spark, d):
    return _sdts_attrs(_graph_subfields(spark, d))


@query("sdts_line_attrs", f"with {_ATTRS} select cast(o_orderkey % 3 as varchar) as file, o_orderkey as id, string_agg(a.major || '.' || a.minor, ' ' order by a.k) as attrs from orders join a on a.file = cast(o_orderkey % 3 as varchar) and a.rcid = o_orderkey % 25 and a.module = case when o_orderkey % 5 = 0 then 'AHYF' else 'ARDF' end group by 1, 2")
def sdts_line_attrs(spark, d):
    """Lines to the attribute records that they name."""
    sub = _graph_subfields(spark, d)
    got = vector.with_attributes(sdts.links(sub, "LE", "LINE"), _sdts_attrs(sub))
    return got.select("file", "id", F.array_join(F.transform("attrs", lambda a: F.concat_ws(".", a["major"].cast("string"), a["minor"].cast("string"))), " ").alias("attrs"))


@query("sdts_area_attrs", f"with {_ATTRS} select cast(n_nationkey % 3 as varchar) as file, n_nationkey + 2 as id, string_agg(a.major || '.' || a.minor, ' ' order by a.k) as attrs from nation join a on a.file = cast(n_nationkey % 3 as varchar) and a.rcid = n_nationkey and a.module = 'AHYF' group by 1, 2")
def sdts_area_attrs(spark, d):
    sub = _graph_subfields(spark, d)
    got = vector.polygon_attributes(sdts.areas(sub), sdts.polygons(sub), _sdts_attrs(sub))
    return got.select("file", "id", F.array_join(F.transform("attrs", lambda a: F.concat_ws(".", a["major"].cast("string"), a["minor"].cast("string"))), " ").alias("attrs"))


@query("sdts_modules", "select cast(f.range as varchar) as file, m.name from range(3) f, (values ('AHYF'), ('ARDF')) m(name)")
def sdts_modules(spark, d):
    return sdts.attribute_modules(_graph_subfields(spark, d))


@query("sdts_themes", "select cast(f.range as varchar) as file, m.* from range(3) f, (values ('AHYF', 'HYDROGRAPHY', 50), ('ARDF', 'ROADS AND TRAILS', 170)) m(name, theme, category)")
def sdts_themes(spark, d):
    return sdts.themes(_graph_subfields(spark, d))


@query("sdts_counts", "select cast(f as varchar) as file, count(*) + (select count(*) from region where r_regionkey % 3 = f) as lines, (select count(*) from customer where c_custkey % 3 = f) + (select count(*) from region where r_regionkey % 3 = f) as nodes, (select count(*) from nation where n_nationkey % 3 = f) + 1 as areas, 2 * (count(*) + (select count(*) from region where r_regionkey % 3 = f)) as points, count(*) as links from (select o_orderkey % 3 as f from orders) group by f")
def sdts_counts(spark, d):
    return sdts.counts(_graph_subfields(spark, d))


@query("sdts_rmse", "select p_partkey as id, case when p_partkey % 3 = 0 then 0 else cast(p_size as int) end as x, case when p_partkey % 3 = 0 then 0 else 2 end as y, case when p_partkey % 3 = 0 then 0 else 3 end as z, case when p_partkey % 3 = 2 then 30 else 0 end as size, case when p_partkey % 3 = 0 then 0 else 1 end as stats from part")
def sdts_rmse(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "ACCURACY: Unspecified").otherwise(F.concat(F.lit("ACCURACY: RMSE of the DEM relative to file's datum (x,y,z): (9,9,9); accuracy is estimated, to absolute datum (x,y,z): ("), F.col("p_size").cast("string"), F.when(k % 3 == 1, ", 2, 3); accuracy is estimated.").otherwise(", 2, 3); accuracy has been tested with a sample size of 30.")))
    return table(spark, d, "part").select(k.alias("id"), sdts.rmse(text, "absolute datum").alias("r")).select("id", "r.*")


@query("sdts_producer", "select p_partkey as id, list_extract(['', 'NMD', 'MCMC', 'Some'], cast(p_partkey % 4 as int) + 1) as origin from part")
def sdts_producer(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("DEM PRODUCER:  Unspecified", "DEM PRODUCER:  National Mapping Division", "DEM PRODUCER:  Mid-Continent Mapping Center", "DEM PRODUCER:  Somebody"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), sdts.producer(text).alias("origin"))


@query("sdts_layer", "select p_partkey as id, cast(p_partkey % 10 as int) + 1 as cell, cast(p_partkey % 60 as int) as line from part")
def sdts_layer(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), sdts.layer_of(F.format_string("x/1107CEL%d.DDF", (k % 10).cast("int"))).alias("cell"), sdts.layer_of(F.format_string("x/HY01LE%02d.ddf.gz", (k % 60).cast("int")), 2).alias("line"))


@query("info_lines", f"{PTS} select id, name || '.dem' || chr(9) || lpad(substr(class, 1, 40), 40, ' ') || chr(9) || printf('%.6g:%.6g:%.6g:%.6g', lat, lon + 1, lat + 1, lon) || chr(9) || id || ':' || (id + 100) || chr(9) || '1201:1201' || chr(9) || case when id % 2 = 0 then 'linefeeds=yes' else 'linefeeds=no' end as line from geo_points")
def info_lines(spark, d):
    i, lat, lon = F.col("id"), F.col("lat"), F.col("lon")
    line = sinks.model_line(F.concat("name", F.lit(".dem")), F.col("class"), (lat, lon + 1, lat + 1, lon), i, i + 100, F.lit(1201), F.lit(1201), i % 2 == 0)
    return geo_points(spark, d).select("id", line.alias("line"))
