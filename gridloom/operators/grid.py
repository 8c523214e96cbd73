"""Operators on elevation cells ``(i, j, elev)``: row 0 is north, column 0 west, a null elevation is no data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import NO_DATA, ORANGE, WHITE


def mosaic(cells: DataFrame) -> DataFrame:
    """``(seq, i, j, elev)`` -> the elevation of the last source that has one."""
    return cells.filter("elev is not null").groupBy("i", "j").agg(F.max_by("elev", "seq").alias("elev"))


def extremes(cells: DataFrame) -> DataFrame:
    """Lowest and highest elevation, each where it comes first in row order."""
    some = cells.filter("elev is not null")
    return some.agg(F.min("elev").alias("lo"), F.min(F.struct("elev", "i", "j")).alias("a"), F.max("elev").alias("hi"), F.min(F.struct((-F.col("elev")).alias("n"), "i", "j")).alias("b")).select(F.col("lo").alias("min_elev"), F.col("a.i").alias("min_i"), F.col("a.j").alias("min_j"), F.col("hi").alias("max_elev"), F.col("b.i").alias("max_i"), F.col("b.j").alias("max_j"))


def profile_stats(cells: DataFrame) -> DataFrame:
    """Per column: samples with data and their range, 100000 and -100000 if there are none."""
    return cells.groupBy("j").agg(F.count("elev").alias("n"), F.coalesce(F.min("elev"), F.lit(100000)).alias("lo"), F.coalesce(F.max("elev"), F.lit(-100000)).alias("hi"))


def around(cells: DataFrame, offsets: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds the elevation at each offset ``name: (rows down, columns right)``.

    One pass of cells over the offsets and one aggregation by cell, so the plan has a single shuffle for any stencil.
    """
    names = list(offsets)
    spread = cells.select("elev", F.explode(F.array(*(F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate([(0, 0), *offsets.values()])))).alias("t")).select("t.i", "t.j", "t.k", "elev")
    pick = lambda k, name: F.max(F.when(F.col("k") == k, F.col("elev"))).alias(name)
    out = spread.groupBy("i", "j").agg(F.count_if(F.col("k") == 0).alias("own"), pick(0, "elev"), *(pick(k + 1, n) for k, n in enumerate(names)))
    return out.filter("own > 0").drop("own")


def spacing(lat: float, dlat: float, dlon: float, width: int, height: int) -> tuple[float, float]:
    """Metres between rows, and between diagonal neighbours, at a latitude."""
    north = 1.1095e5
    diagonal = math.sqrt(north**2 + (1.1132e5 * math.cos(math.radians(lat))) ** 2)
    return dlat / height * north, math.sqrt((dlat**2 + dlon**2) / (width**2 + height**2)) * diagonal


def row_spacing(row: Column, north: float, dlat: float, dlon: float, width: int, height: int) -> Column:
    """Metres between diagonal neighbours at each row of an image whose upper edge lies at ``north``."""
    lat = north - row.cast("double") / height * dlat
    east = 1.1132e5 * F.cos(F.radians(lat))
    return math.sqrt((dlat**2 + dlon**2) / (width**2 + height**2)) * F.sqrt(1.1095e5**2 + east * east)


def gradient(cells: DataFrame, res_y: float, res_xy: float | Column, magnify: float = 1.0) -> DataFrame:
    """The steeper of the falls from the north-west and north neighbours; cells without both, or without data, have none.

    ``res_xy`` may be a column of the row ``i``, as in ``row_spacing``.
    """
    near = around(cells, {"n": (-1, 0), "nw": (-1, -1)})
    known = F.col("n").isNotNull() & F.col("nw").isNotNull() & F.col("elev").isNotNull()
    across = res_xy if isinstance(res_xy, Column) else F.lit(res_xy)
    slope = F.greatest((F.col("nw") - F.col("elev")) / across, (F.col("n") - F.col("elev")) / F.lit(res_y), F.lit(-1e10)) * magnify
    return near.select("i", "j", "elev", F.when(known, slope).alias("gradient"))


def tile_stats(cells: DataFrame, size: int = 16) -> DataFrame:
    """Per tile of ``size`` rows and columns: samples with data and their range."""
    at = lambda c, n: F.floor(F.col(c) / size).cast("int").alias(n)
    return cells.groupBy(at("i", "ti"), at("j", "tj")).agg(F.count("elev").alias("n"), F.min("elev").alias("lo"), F.max("elev").alias("hi"))


def longest_profile(profiles: DataFrame) -> DataFrame:
    """Per file the most samples of a profile ``(file, samples)``."""
    return profiles.groupBy("file").agg(F.max(F.size("samples")).alias("longest"))


def contour_level(v: Column, step: float) -> Column:
    return F.round(F.ceil(F.floor(v / step) * step)).cast("int")


def contours(cells: DataFrame, step: float, fill: bool = False, mask: bool = False) -> DataFrame:
    """Orange where a cell's level is above any of its eight neighbours'.

    Cells without data count as very high, which draws lines around holes; ``mask`` leaves them out and white instead.
    The first row and column are left out, and the last of each is white.
    """
    full = cells.select("i", "j", contour_level(F.coalesce("elev", F.lit(NO_DATA)), step).alias("elev"))
    ring = {f"d{k}": o for k, o in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}
    near = around(full, ring)
    void = contour_level(F.lit(NO_DATA), step)
    low = F.least(*((F.when(F.col(k) != void, F.col(k)) if mask else F.col(k)) for k in ring))
    inner = F.greatest(*(F.col(k).isNull().cast("int") for k in ring)) == 0
    bare = (F.col("elev") == void) if mask else F.lit(False)
    plain = (F.pmod(F.round(F.floor(F.col("elev") / step)).cast("int"), F.lit(13)) * 16) if fill else F.lit(WHITE)
    return near.filter("i >= 1 and j >= 1").select("i", "j", F.when(~inner | bare, F.lit(WHITE)).when(F.col("elev") > low, F.lit(ORANGE)).otherwise(plain).alias("color"))


def kernel(radius: int, spread: float | None = None) -> list[tuple[int, int, int]]:
    """``(rows, columns, weight)``; without a spread all weights are 1, else those of a bell of that size."""
    weight = lambda a, b: 1 if spread is None else int(10 * math.exp(-(a * a + b * b) / (2 * (spread / 2) ** 2)) + 0.5)
    return [(a, b, weight(a, b)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def smooth(cells: DataFrame, weights: list[tuple[int, int, int]], keep_void: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of the neighbours that have data, rounded; ``keep_void`` leaves cells without data as they are.
    ``by`` names columns that keep grids apart.

    Values are sent to their neighbours' rows as partial sums: the shuffle carries one row per target and map task.
    """
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in weights if w > 0))
    sent = cells.filter("elev is not null").select(*by, "elev", "i", "j", F.explode(table).alias("t")).select(*by, (F.col("i") + F.col("t.a")).alias("i"), (F.col("j") + F.col("t.b")).alias("j"), (F.col("elev") * F.col("t.w")).cast("long").alias("v"), F.col("t.w").cast("long").alias("w"), F.lit(0).alias("own"), F.lit(None).cast("int").alias("was"))
    own = cells.select(*by, "i", "j", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("own"), F.col("elev").alias("was"))
    out = sent.union(own).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.max("own").alias("own"), F.max("was").alias("was")).filter("own = 1")
    mean = F.when(F.col("w") > 0, F.round(F.col("v") / F.col("w")).cast("int"))
    return out.select(*by, "i", "j", (F.when(F.col("was").isNotNull(), mean) if keep_void else mean).alias("elev"))


#: Opposite neighbours (rows, columns) that may bridge a cell without data.
BRIDGES = (((0, -1), (0, 1)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1)), ((-1, -2), (1, 2)), ((-1, 2), (1, -2)), ((0, -2), (0, 2)), ((-1, 0), (1, 0)))


def fill_voids_parallel(cells: DataFrame) -> DataFrame:
    """One pass over the unfilled grid: mean of all bridges whose two ends have data, truncated."""
    near = around(cells, {f"p{k}{s}": o for k, pair in enumerate(BRIDGES) for s, o in zip("ab", pair, strict=True)})
    both = [F.col(f"p{k}a").isNotNull() & F.col(f"p{k}b").isNotNull() for k in range(len(BRIDGES))]
    total = sum((F.when(c, F.col(f"p{k}a") + F.col(f"p{k}b")).otherwise(0) for k, c in enumerate(both)), F.lit(0))
    n = sum((c.cast("int") for c in both), F.lit(0)) * 2
    return near.select("i", "j", F.coalesce("elev", F.when(n > 0, (total / n).cast("int"))).alias("elev"))


def as_rows(cells: DataFrame) -> DataFrame:
    """``(i, first, elevs)``: each row as an array from its first column on, gaps as nulls."""
    span = cells.agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    packed = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "elev"))).alias("m"))
    return packed.crossJoin(F.broadcast(span)).select("i", F.col("lo").alias("first"), F.transform(F.sequence("lo", "hi"), lambda k: F.try_element_at("m", k)).alias("elevs"))  # span is one row


def fill_voids(cells: DataFrame) -> DataFrame:
    """Void fill in row order: cells to the left count as filled already, the rows above and below as they came.

    Rows therefore do not depend on each other; each is worked on with its two neighbours.
    """
    rows = as_rows(cells)
    near = lambda d, name: rows.select((F.col("i") - d).alias("i"), F.col("elevs").alias(name))
    three = rows.join(near(-1, "up"), "i", "left").join(near(1, "down"), "i", "left")

    @F.pandas_udf("array<int>")
    def run(own: pd.Series, up: pd.Series, down: pd.Series) -> pd.Series:
        width = max((len(x) for x in own), default=0)
        table = lambda s: np.array([[np.nan] * width if x is None else [np.nan if v is None else v for v in np.asarray(x, object)] for x in s], float).reshape(-1, width)
        grid = {0: table(own), -1: table(up), 1: table(down)}
        for j in range(width):
            total, n = np.zeros(len(own)), np.zeros(len(own))
            for (ai, aj), (bi, bj) in BRIDGES:
                if 0 <= j + aj < width and 0 <= j + bj < width:
                    v = grid[ai][:, j + aj] + grid[bi][:, j + bj]
                    total += np.where(np.isnan(v), 0, v)
                    n += np.where(np.isnan(v), 0, 2)
            cur = grid[0][:, j]
            grid[0][:, j] = np.where(np.isnan(cur) & (n > 0), np.trunc(total / np.maximum(n, 1)), cur)
        return pd.Series([[None if np.isnan(v) else int(v) for v in r] for r in grid[0]])

    done = three.select("i", "first", F.posexplode(run("elevs", "up", "down")).alias("k", "elev"))
    return done.select("i", (F.col("first") + F.col("k")).alias("j"), "elev").join(cells.select("i", "j"), ["i", "j"], "left_semi")


def interpolate_columns(cells: DataFrame, times: int) -> DataFrame:
    """Sets ``times - 1`` rounded values between neighbouring columns."""
    w = Window.partitionBy("i").orderBy("j")
    pair = cells.select("i", "j", "elev", F.lead("elev").over(w).alias("nxt"), F.lead("j").over(w).alias("jn"))
    each = pair.select("i", "j", "elev", "nxt", "jn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k")).filter((F.col("k") == 0) | (F.col("jn") == F.col("j") + 1))
    mid = F.round((F.col("elev") * (times - F.col("k")) + F.col("nxt") * F.col("k")) / times).cast("int")
    return each.select("i", (F.col("j") * times + F.col("k")).alias("j"), F.when(F.col("k") == 0, F.col("elev")).otherwise(mid).alias("elev"))


def resample(cells: DataFrame, rows: int, cols: int, width: int, height: int) -> DataFrame:
    """Nearest sample for every pixel of a width x height image of a rows x cols grid."""
    spark = cells.sparkSession
    px = spark.range(height).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    at = lambda c, n, m: F.round(F.lit(float(n - 1)) * F.col(c) / float(max(1, m - 1))).cast("int")
    return px.select("i", "j", at("i", rows, height).alias("k"), at("j", cols, width).alias("l")).join(cells.select(F.col("i").alias("k"), F.col("j").alias("l"), "elev"), ["k", "l"], "left").select("i", "j", "elev")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "elev")


def height_range(cells: DataFrame) -> DataFrame:
    """``(lo, hi)`` of the height field: cells without data are not counted, those below sea level count as 0."""
    up = F.greatest("elev", F.lit(0))
    return cells.filter("elev is not null").agg(F.min(up).alias("lo"), F.max(up).alias("hi"))


def height_field(cells: DataFrame) -> DataFrame:
    """0 for no data and below sea level, else scaled so that the highest is 65535."""
    top = cells.agg(F.max(F.greatest("elev", F.lit(0))).alias("top"))
    up = F.greatest(F.coalesce("elev", F.lit(0)), F.lit(0))
    return cells.crossJoin(F.broadcast(top)).select("i", "j", F.when(F.col("top") > 0, F.round(up * 65535.0 / F.col("top")).cast("int")).otherwise(F.lit(0)).alias("height"))  # top is one row
