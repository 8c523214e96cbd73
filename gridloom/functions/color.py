"""Elevation bands, shading factors and the colour ramp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_DATA = 32000
BANDS, SHADES = 14, 16
# Colour numbers of the special block.
BRIGHT_BLUE, BLACK, GRAY, ORANGE, WHITE = 242, 243, 244, 245, 246
# Upper elevation of the first 13 bands (metres); the 14th takes the rest.
LIMITS = (305, 610, 914, 1219, 1524, 1829, 2134, 2438, 2743, 3048, 3353, 3658, 3962, NO_DATA)
# Shares of a half turn that part the 16 shades.
TURNS = (0.405, 0.445, 0.470, 0.485, 0.495, 0.497, 0.499, 0.500, 0.501, 0.503, 0.505, 0.515, 0.530, 0.555, 0.595)
# Red, green, blue of the 14 bands of the four palettes, and their bands for water.
PALETTES = {
    1: ((190, 255, 175), (190, 244, 174), (190, 233, 174), (190, 222, 173), (190, 211, 172), (190, 200, 170), (185, 187, 165), (180, 174, 160), (175, 162, 155), (170, 150, 150), (160, 160, 160), (190, 190, 190), (220, 220, 220), (255, 255, 255)),
    2: ((190, 255, 175), (195, 237, 165), (200, 210, 156), (205, 194, 147), (210, 178, 138), (215, 162, 129), (220, 145, 120), (207, 150, 135), (193, 155, 150), (179, 160, 165), (165, 165, 180), (210, 210, 255), (232, 232, 255), (255, 255, 255)),
    3: ((60, 255, 60), (150, 255, 30), (200, 255, 0), (218, 225, 20), (237, 205, 40), (255, 185, 60), (255, 145, 95), (255, 125, 115), (225, 138, 150), (195, 152, 150), (165, 165, 180), (210, 210, 255), (232, 232, 255), (255, 255, 255)),
    4: ((60, 255, 60), (255, 255, 60), (255, 165, 60), (255, 60, 60), (255, 60, 255), (60, 255, 255), (165, 255, 165), (255, 255, 165), (255, 210, 165), (255, 165, 165), (255, 165, 255), (165, 165, 255), (165, 255, 255), (255, 255, 255)),
}
SEA_BANDS = {1: 10, 2: 10, 3: 10, 4: 11}
DEFAULT_PALETTE = 2


def shade_factor(gradient: Column) -> Column:
    """0 (steep one way) to 15 (steep the other way) by the angle of the slope."""
    turn = (F.atan(gradient) + F.lit(1.5707963267948966)) / F.lit(3.141592653589793)
    out = F.lit(15)
    for k in reversed(range(len(TURNS))):
        out = F.when(turn < TURNS[k], F.lit(k)).otherwise(out)
    return F.when(gradient.isNotNull(), out)


def stretched(low: int, high: int) -> tuple[int, ...]:
    """Band limits that span the data's own range."""
    base = max(low, 0)
    return tuple(base + int((k + 1) * (high - base) / BANDS + 0.5) for k in range(BANDS - 1)) + (NO_DATA,)


def band_of(elev: Column, limits=LIMITS) -> Column:
    """The first band whose limit is not below the elevation; null for none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(limits))):
        out = F.when(elev <= limits[k], F.lit(k)).otherwise(out)
    return out


def relief_color(elev: Column, gradient: Column, limits=LIMITS, seacoast: bool = False, palette: int = DEFAULT_PALETTE) -> Column:
    """The colour number of a shaded cell; a cell without elevation or gradient is white."""
    f = shade_factor(gradient)
    sea = F.lit(SEA_BANDS[palette] * SHADES) + f
    zero = F.when(gradient == 0, F.lit(BRIGHT_BLUE)).otherwise(sea) if seacoast else f
    return F.when(elev.isNull() | gradient.isNull(), F.lit(WHITE)).when(elev < 0, sea).when(elev == 0, zero).otherwise(band_of(elev, limits) * SHADES + f)


def shade_ramp(spark: SparkSession, palette: int = DEFAULT_PALETTE, relief: float = 1.0) -> DataFrame:
    """``(idx, r, g, b)``: each band's colour and 15 darker shades of it."""
    base = spark.createDataFrame([(k, *c) for k, c in enumerate((*PALETTES[palette], (0, 0, 0), (0, 0, 0)))], "band int, r0 int, g0 int, b0 int")
    each = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    dim = lambda c: F.when((F.col("j") == 15) & F.lit(relief == 1.0), F.lit(0)).otherwise(F.col(c) - F.round(F.col("j") * relief * F.col(c) / 15.0).cast("int")).cast("int")
    return each.select((F.col("band") * 16 + F.col("j")).alias("idx"), dim("r0").alias("r"), dim("g0").alias("g"), dim("b0").alias("b"))


def dimmed(idx: Column) -> Column:
    """Half way from a shade to the darkest of its band, as behind text."""
    return idx + F.shiftright(F.lit(16) - idx.bitwiseAND(F.lit(15)), 1)
