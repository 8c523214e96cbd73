"""From tiles to an image: overlap windows, resampling, smoothing by resolution, labels, ticks, legend and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color, geodesy
from . import grid

#: Samples of a one-degree model, the largest smoothing radius, and the borders around a map.
DEGREE_SAMPLES, MOST_RADIUS = 1201, 10
LEFT, RIGHT, TOP, BOTTOM = 60, 60, 60, 80
CHART_WIDTH = 224
FEET = 3.28084


class Frame:
    """The box (south, west, north, east) of an image and its size in pixels."""

    def __init__(self, box: tuple[float, float, float, float], width: int, height: int):
        south, west, north, east = box
        self.south, self.north = sorted((south, north))
        self.west, self.east = sorted((west, east))
        if not (-90 <= self.south < self.north <= 90 and -180 <= self.west < self.east <= 180):
            raise ValueError("a box has two latitudes from -90 to 90 and two longitudes from -180 to 180")
        if width < 4 or height < 4:
            raise ValueError("an image has 4 pixels at least either way")
        self.width, self.height = width, height


def checked(relief: float = 1.0, magnify: float = 1.0, contour: float | None = None, palette: int = 2) -> None:
    """Refuses what no map can be drawn with."""
    if not 0 <= relief <= 1:
        raise ValueError("the relief factor is from 0 to 1")
    if magnify < 1:
        raise ValueError("the magnification is 1 or more")
    if contour is not None and contour <= 0:
        raise ValueError("the contour interval is above 0")
    if palette not in color.PALETTES:
        raise ValueError("there are palettes 1 to 4")


def default_size(span: float | None, samples: int | None = None) -> int:
    """Pixels for a span of degrees at half the resolution of a one-degree model; that of one degree where no box is given,
    and one less than the samples where a single model is drawn."""
    if samples is not None:
        return samples - 1
    return (DEGREE_SAMPLES - 1) // 2 if span is None else int(math.floor(0.5 * span * (DEGREE_SAMPLES - 1) + 0.5))


def border(size: int, plain: int) -> int:
    """An odd image takes a border one wider, so that the whole is even."""
    return plain + size % 2


def to_pixel(lat: Column, lon: Column, f: Frame) -> tuple[Column, Column]:
    """(x, y) of a point: x from -1, y from the top."""
    x = -1 + F.round((lon - f.west) * float(f.width) / (f.east - f.west))
    return x.cast("int"), (f.height - 1 - F.round((lat - f.south) * float(f.height) / (f.north - f.south))).cast("int")


def to_latlon(i: Column, j: Column, f: Frame) -> tuple[Column, Column]:
    """(latitude, longitude) of row i and column j of the grid."""
    return f.south + (f.north - f.south) * (f.height - i) / float(f.height), f.west + (f.east - f.west) * j / float(f.width)


def windows(tiles: DataFrame, f: Frame) -> DataFrame:
    """Adds to ``tiles(sw_lat, sw_lon, ne_lat, ne_lon, rows, cols)`` what they share with the image: lat1, lat2, lon1, lon2,
    the part of the tile (w, h, x0, y0) and of the image (x_low, x_high, y_low, y_high). Tiles outside are dropped.

    The tile's part is rounded first, then the image's, whose high ends are one larger as rows and columns end ahead of them.
    """
    c = F.col
    inside = (c("sw_lat") < f.north) & (c("ne_lat") > f.south) & (c("sw_lon") < f.east) & (c("ne_lon") > f.west)
    one = tiles.filter(inside).withColumns({"lat1": F.greatest(c("sw_lat"), F.lit(f.south)), "lon1": F.greatest(c("sw_lon"), F.lit(f.west)), "lat2": F.least(c("ne_lat"), F.lit(f.north)), "lon2": F.least(c("ne_lon"), F.lit(f.east))})
    dx, dy = c("ne_lon") - c("sw_lon"), c("ne_lat") - c("sw_lat")
    r = lambda v: F.round(v).cast("int")
    return one.withColumns({
        "w": r((c("cols") - 1) * (c("lon2") - c("lon1")) / dx),
        "h": r((c("rows") - 1) * (c("lat2") - c("lat1")) / dy),
        "x0": r((c("cols") - 1) * (c("lon1") - c("sw_lon")) / dx),
        "y0": c("rows") - 1 - r((c("rows") - 1) * (c("lat2") - c("sw_lat")) / dy),
        "x_low": r(f.width * (c("lon1") - f.west) / (f.east - f.west)),
        "x_high": r((f.width + 1) * (c("lon2") - f.west) / (f.east - f.west)),
        "y_low": f.height - r(f.height * (c("lat2") - f.south) / (f.north - f.south)),
        "y_high": f.height + 1 - r(f.height * (c("lat1") - f.south) / (f.north - f.south)),
    })


def _pixels(win: DataFrame) -> DataFrame:
    """A row per pixel of each window's part of the image; rows and columns are dealt out one after the other."""
    rows = win.filter("y_high > y_low and x_high > x_low").withColumn("i", F.explode(F.sequence(F.col("y_low"), F.col("y_high") - 1)))
    return rows.withColumn("j", F.explode(F.sequence(F.col("x_low"), F.col("x_high") - 1)))


def sources(win: DataFrame) -> DataFrame:
    """``(tile, seq, i, j, k, l)``: the sample (k, l) of a geographic tile nearest to each pixel (i, j) of its window."""
    part = lambda low, at, high, n, first: F.col(first) + F.round(F.try_divide((F.col(n) * (F.col(at) - F.col(low))).cast("double"), (F.col(high) - 1 - F.col(low)).cast("double"))).cast("int")
    each = _pixels(win)
    return each.select("tile", "seq", "i", "j", F.coalesce(part("y_low", "i", "y_high", "h", "y0"), F.col("y0")).alias("k"), F.coalesce(part("x_low", "j", "x_high", "w", "x0"), F.col("x0")).alias("l"))


def sources_utm(win: DataFrame, datum: str = "nad27") -> DataFrame:
    """The same for tiles in metres ``(..., x_res, y_res, x_min, x_max, y_min, y_max)``: pixels are projected with the tile's
    datum and rounded to its spacing; what falls beside the tile is dropped."""
    c = F.col
    lat = c("lat2") - F.coalesce(F.try_divide((c("i") - c("y_low")) * (c("lat2") - c("lat1")), (c("y_high") - c("y_low") - 1).cast("double")), F.lit(0.0))
    lon = c("lon1") + F.coalesce(F.try_divide((c("j") - c("x_low")) * (c("lon2") - c("lon1")), (c("x_high") - c("x_low") - 1).cast("double")), F.lit(0.0))
    each = geodesy.add_utm(_pixels(win).withColumns({"plat": lat, "plon": lon}), "plat", "plon", datum)
    near = each.withColumns({"ux": F.rint(c("utm_x") / c("x_res")) * c("x_res"), "uy": F.rint(c("utm_y") / c("y_res")) * c("y_res")})
    k = c("rows") - 1 - F.round((c("rows") - 1) * (c("uy") - c("y_min")) / (c("y_max") - c("y_min"))).cast("int")
    col = F.round((c("cols") - 1) * (c("ux") - c("x_min")) / (c("x_max") - c("x_min"))).cast("int")
    # As an array of one, so that the projection is worked out once and not again in a filter.
    hit = F.filter(F.array(F.struct(k.alias("k"), col.alias("l"))), lambda t: t["k"].between(0, c("rows") - 1) & t["l"].between(0, c("cols") - 1))
    return near.select("tile", "seq", "i", "j", F.explode(hit).alias("t")).select("tile", "seq", "i", "j", "t.k", "t.l")


def fetch(hits: DataFrame, cells: DataFrame, radius: int = 0) -> DataFrame:
    """``(tile, seq, i, j, k, l)`` and ``cells(tile, i, j, elev)`` -> ``(tile, seq, i, j, elev)`` of hits with data. With a radius
    the mean around the sample in its own tile stands for it."""
    own = cells.filter("elev is not null")
    if radius:
        own = grid.smooth(own, grid.kernel(radius), by=("tile",))
    return hits.join(own.select("tile", F.col("i").alias("k"), F.col("j").alias("l"), "elev"), ["tile", "k", "l"]).select("tile", "seq", "i", "j", "elev")


def blank(spark: SparkSession, f: Frame) -> DataFrame:
    """``(i, j)`` of every sample of the image, one more than pixels either way."""
    rows = spark.range(f.height + 1).select(F.col("id").cast("int").alias("i"))
    return rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(f.width))).alias("j"))


def resolutions(tiles: DataFrame, f: Frame) -> DataFrame:
    """Adds samples a degree of each tile, whether its data are to be smoothed and how far, and whether the image is."""
    c = F.col
    ix, iy = f.width / (f.east - f.west), f.height / (f.north - f.south)
    one = tiles.withColumns({"res_x": (c("cols") - 1) / (c("ne_lon") - c("sw_lon")), "res_y": (c("rows") - 1) / (c("ne_lat") - c("sw_lat"))})
    data = (F.lit(1.5 * iy) < c("res_y")) | (F.lit(1.5 * ix) < c("res_x"))
    radius = F.greatest(F.lit(1), F.round(F.least(F.lit(float(MOST_RADIUS)), c("res_y") / iy - 1, c("res_x") / ix - 1)).cast("int"))
    return one.withColumns({"smooth_data": data, "radius": F.when(data, radius).otherwise(F.lit(0)), "smooth_image": (1.05 * c("res_y") < iy) | (1.05 * c("res_x") < ix)})


def image_radius(res: DataFrame, f: Frame) -> DataFrame:
    """``(smooth, radius)``: any tile may call for smoothing of the image; the last one's resolution says how far."""
    ix, iy = f.width / (f.east - f.west), f.height / (f.north - f.south)
    last = res.agg(F.bool_or("smooth_image").alias("smooth"), F.max_by(F.struct("res_x", "res_y"), "seq").alias("r"))
    radius = F.greatest(F.lit(1), F.round(F.least(F.lit(float(MOST_RADIUS)), iy / F.col("r.res_y"), ix / F.col("r.res_x"))).cast("int"))
    return last.select("smooth", F.when(F.col("smooth"), radius).otherwise(F.lit(0)).alias("radius"))


def graph_box(sw_lat: Column, sw_lon: Column, ne_lat: Column, ne_lon: Column, f: Frame) -> Column:
    """struct<x_low, y_low, x_high, y_high> of a line graph in pixels, cut off at the image."""
    (x1, y2), (x2, y1) = to_pixel(sw_lat, sw_lon, f), to_pixel(ne_lat, ne_lon, f)
    low = lambda v: F.greatest(v, F.lit(-1))
    return F.struct(low(x1).alias("x_low"), low(y1).alias("y_low"), F.least(x2, F.lit(f.width - 1)).alias("x_high"), F.least(y2, F.lit(f.height - 1)).alias("y_high"))


def label_place(x: Column, y: Column, length: Column, f: Frame, font: tuple[int, int] = (5, 8)) -> Column:
    """struct<x, y> where a name of ``length`` characters begins: right of its point, or left where it would run over; kept
    inside from top to bottom."""
    w, h = font
    left = F.when(x + 5 + length * w >= f.width, x - 5 - length * w).otherwise(x + 5)
    up = F.when(y + h // 2 - 1 >= f.height, F.lit(f.height - h)).when(y - h // 2 < 0, F.lit(0)).otherwise(y - h // 2)
    return F.struct(left.cast("int").alias("x"), up.cast("int").alias("y"))


def cursors(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Crosses of 13 pixels at ``points(id, x, y)``: white, or black where one of the pixels ``(x, y, color)`` under it is white.

    The crosses are told to meet the pixels by a merge: Spark's estimate of an explode leaves out that it makes 13 rows of
    one, so it would broadcast them. A cross's pixels come together by its id once.
    """
    arm = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted({(k, 0) for k in range(-3, 4)} | {(0, k) for k in range(-3, 4)}))))
    cross = points.select("id", "x", "y", arm.alias("t")).select("id", (F.col("x") + F.col("t.a")).alias("x"), (F.col("y") + F.col("t.b")).alias("y"))
    under = cross.hint("merge").join(pixels.select("x", "y", F.col("color").alias("was")), ["x", "y"])
    return under.select("id", "x", "y", F.when(F.bool_or(F.col("was") == color.WHITE).over(Window.partitionBy("id")), color.BLACK).otherwise(color.WHITE).alias("color"))


def text_pixels(labels: DataFrame, glyphs: DataFrame, font: tuple[int, int], ink: int, paper: int = -1) -> DataFrame:
    """``labels(id, text, x, y)`` and ``glyphs(code, row, bits)`` -> ``(id, x, y, color)``; bits: a row of a character, its left
    pixel highest. Paper -1 leaves the ground as it is. The glyph table is as large as the font."""
    w, _ = font
    chars = labels.select("id", "x", "y", F.posexplode(F.split("text", "")).alias("n", "ch")).filter("ch <> ''").withColumn("code", F.ascii("ch"))
    rows = chars.join(F.broadcast(glyphs.filter("code between 0 and 255")), "code")  # 256 codes of a font's height
    dots = rows.select("id", (F.col("x") + F.col("n") * w).alias("x0"), (F.col("y") + F.col("row")).cast("int").alias("y"), "bits", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("k"))
    on = F.expr(f"(shiftright(bits, {w - 1} - k) & 1) = 1")
    return dots.select("id", (F.col("x0") + F.col("k")).cast("int").alias("x"), "y", F.when(on, F.lit(ink)).otherwise(F.lit(paper)).alias("color")).filter("color >= 0")


def general(v: Column, digits: int) -> Column:
    """A number with so many digits and no zeros at the end, as by %.<digits>g, for values from 0.0001 up to 10 to the digits;
    what stands half way between two as a decimal goes away from zero."""
    a, out = F.abs(v), F.lit("0")
    for e in range(-4, digits):
        own = F.regexp_replace(F.format_string(f"%.{digits - 1 - e}f", v), r"(\.\d*?)0+$", "$1")
        out = F.when(a >= 10.0**e * (1 - 0.5 * 10.0**-digits), F.regexp_replace(own, r"\.$", "")).otherwise(out)
    return out


def corner_label(f: Frame) -> str:
    """The box in words, as over a map."""
    side = lambda v, d, a, b: f"{abs(v):.{d}g}{b if v < 0 else a}"
    return f"{side(f.south, 5, 'N', 'S')}, {side(f.west, 6, 'E', 'W')} to {side(f.north, 5, 'N', 'S')}, {side(f.east, 6, 'E', 'W')}"


def elevation_label(ext: DataFrame, f: Frame) -> DataFrame:
    """``grid.extremes`` in words: metres, feet, and where they are."""
    c = F.col

    def at(kind: str) -> list[Column]:
        lat, lon = to_latlon(c(f"{kind}_i"), c(f"{kind}_j"), f)
        words = [general(F.abs(lat), 5), F.when(lat < 0, "S").otherwise("N"), general(F.abs(lon), 6), F.when(lon < 0, "W").otherwise("E")]
        return [c(f"{kind}_elev").cast("int"), F.round(c(f"{kind}_elev") * FEET).cast("int"), *words]

    return ext.select(F.format_string("Elevations: %dm (%dft) at %s%s %s%s, %dm (%dft) at %s%s %s%s", *at("min"), *at("max")).alias("label"))


def ticks(spark: SparkSession, f: Frame) -> DataFrame:
    """``(side, at, width, label)``: a tick for each tenth of a degree, wide and with a label at halves (label null otherwise).

    side: lat (at: row) or lon (at: column), in pixels of the whole picture with its borders.
    """
    rows = []
    for side, low, high, size in (("lat", f.south, f.north, f.height), ("lon", f.west, f.east, f.width)):
        k = int(math.copysign(math.floor(abs((low + 0.049999999999) * 10) + 0.5), low + 0.049999999999))
        while k <= (high + 1e-7) * 10:
            v = size * (k * 0.1 - low) / (high - low)
            way = int(math.copysign(math.floor(abs(v) + 0.5), v))
            at = TOP - 1 + size - way if side == "lat" else LEFT - 1 + way
            wide = k % 5 == 0 and (side == "lat" or k % 10 == 0 or size / (high - low) > 75)
            names = ("S", "N") if side == "lat" else ("W", "E")
            rows.append((side, at, 6 if wide else 4, f"{abs(k / 10):.2f}{names[k >= 0]}" if wide else None))
            k += 1
    return spark.createDataFrame(rows, "side string, at int, width int, label string")


def tick_pixels(marks: DataFrame, f: Frame) -> DataFrame:
    """Black pixels ``(x, y, color)`` of ticks on both sides of the picture."""
    steps = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("k")
    each = marks.select("side", "at", steps)
    lat = each.filter("side = 'lat'").select(F.explode(F.array(F.lit(LEFT - 1) - F.col("k"), F.lit(f.width + LEFT) + F.col("k"))).alias("x"), F.col("at").alias("y"))
    lon = each.filter("side = 'lon'").select(F.col("at").alias("x"), F.explode(F.array(F.lit(TOP - 1) - F.col("k"), F.lit(f.height + TOP) + F.col("k"))).alias("y"))
    return lat.union(lon).withColumn("color", F.lit(color.BLACK))


def border_pixels(spark: SparkSession, f: Frame) -> DataFrame:
    """White pixels around the picture."""
    wide, high = f.width + LEFT + border(f.width, RIGHT), f.height + TOP + border(f.height, BOTTOM)
    rows = spark.range(high).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("x"))
    inside = F.col("x").between(LEFT, LEFT + f.width - 1) & F.col("y").between(TOP, TOP + f.height - 1)
    return rows.filter(~inside).select("x", "y", F.lit(color.WHITE).alias("color"))


def legend_pixels(spark: SparkSession, f: Frame, font_height: int = 8) -> DataFrame:
    """``(x, y, color)`` of the strip of 14 bands under the map and of its ticks; none where there is no room."""
    low, wide = border(f.height, BOTTOM), f.width + LEFT + border(f.width, RIGHT)
    x0, mid = LEFT + f.width // 2 - CHART_WIDTH // 2, TOP + f.height + low // 2
    room = wide - 2 >= CHART_WIDTH and low >= 30 + 3 * font_height
    strip = spark.range(CHART_WIDTH if room else 0).select(F.col("id").cast("int").alias("i"))
    y0 = mid - (16 + 4 + font_height * 2) // 2
    bars = strip.select((F.col("i") + x0).alias("x"), F.explode(F.sequence(F.lit(y0), F.lit(y0 + 15))).alias("y"), (F.floor(F.col("i") / 16) * 16 + 3).cast("int").alias("color"))
    marks = spark.range(CHART_WIDTH // 16 + 1 if room else 0).select((F.col("id") * 16 + x0).cast("int").alias("x"), F.explode(F.sequence(F.lit(mid + 6 - font_height), F.lit(mid + 8 - font_height))).alias("y"), F.lit(color.BLACK).alias("color"))
    return bars.union(marks)


def contour_message(step: float) -> str:
    return f"Contour interval is {step:.2f} meters ({step * FEET:.2f} feet)."


def map_name(titles: DataFrame) -> DataFrame:
    """``titles(title)`` -> ``(name)``: of one model the beginning of its title up to three blanks, 40 characters at most."""
    one = F.rtrim(F.get(F.split(F.substring(F.max("title"), 1, 40), " {3}"), F.lit(0)))
    return titles.agg(F.when(F.count("*") == 1, one).when(F.count("*") > 1, F.lit("Data from multiple DEM files")).alias("name"))


def render(tiles: DataFrame, cells: DataFrame, f: Frame, relief: float = 1.0, magnify: float = 1.0, palette: int = 2, stretch: bool = False, seacoast: bool = False, contour: float | None = None, fill: bool = False, utm: bool = False, datum: str = "nad27") -> DataFrame:
    """The map of ``tiles(tile, seq, sw_lat, sw_lon, ne_lat, ne_lon, rows, cols, ...)`` and their ``cells(tile, i, j, elev)``:
    ``(i, j, elev, color)``.

    Windows, nearest samples (or means, where the data are finer than the image), later tiles over earlier ones, void
    fill, smoothing of a coarse image, then shading or contours. Only headers and three numbers come to the driver.
    """
    checked(relief, magnify, contour, palette)
    res = resolutions(windows(tiles, f), f)
    radii = sorted(r.radius for r in res.select("radius").distinct().collect())  # 0 to MOST_RADIUS
    parts = []
    for r in radii:
        own = res.filter(F.col("radius") == r)
        parts.append(fetch(sources_utm(own, datum) if utm else sources(own), cells.join(own.select("tile"), "tile", "left_semi"), r))
    hits = parts[0] if parts else cells.select("tile", F.lit(0).alias("seq"), "i", "j", "elev").limit(0)
    for more in parts[1:]:
        hits = hits.union(more)
    full = blank(tiles.sparkSession, f).join(grid.mosaic(hits), ["i", "j"], "left")
    image = grid.fill_voids(full)
    how = image_radius(res, f).first()
    if how.smooth:
        image = grid.smooth(image, grid.kernel(how.radius, float(how.radius)))
    if contour is not None:
        shaded = grid.contours(image, contour, fill)
    else:
        limits = color.LIMITS
        if stretch:
            span = image.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi")).first()
            limits = color.stretched(span.lo or 0, span.hi or 0)
        res_y = (f.north - f.south) / f.height * 1.1095e5
        across = grid.row_spacing(F.col("i"), f.north, f.north - f.south, f.east - f.west, f.width, f.height)
        shaded = grid.gradient(image, res_y, across, magnify).select("i", "j", color.relief_color(F.col("elev"), F.col("gradient"), limits, seacoast, palette).alias("color"))
    return image.join(shaded, ["i", "j"], "left").select("i", "j", "elev", F.coalesce("color", F.lit(color.WHITE)).alias("color"))
