"""Universal Transverse Mercator both ways, zones, map-sheet codes and quadrangle names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semimajor axis, eccentricity squared and the four coefficients of the meridian arc.
DATUMS = {
    "nad27": (6378206.4, 0.006768658, 0.99830568187775514389, 0.00254255550867060247, 0.00000269808452963108, 0.00000000353308874387),
    "nad83": (6378137.0, 0.00669438002290, 0.99832429844458494622, 0.00251460707284452333, 0.00000263904662023027, 0.00000000341804613677),
    "wgs84": (6378137.0, 0.00669437999013, 0.99832429845279809866, 0.00251460706051444693, 0.00000263904659432867, 0.00000000341804608657),
}
SCALE = 0.9996
NEWTON_STEPS = 5


def utm_zone(lon: Column, east: bool = False) -> Column:
    """A meridian between zones belongs to the western one, or to the eastern if ``east``; the ends are zones 1 and 60."""
    z = F.floor((lon + 180.0) / 6.0) + 1 if east else F.ceil((lon + 180.0) / 6.0)
    return F.when(lon.between(-180.0, 180.0), F.least(F.greatest(z.cast("int"), F.lit(1)), F.lit(60)))


def add_utm(df: DataFrame, lat: str, lon: str, datum: str = "nad27", east: bool = False, prefix: str = "utm_") -> DataFrame:
    """Adds ``<prefix>x``, ``<prefix>y`` (metres) and ``<prefix>zone`` (negative in the south); null out of range and at poles."""
    a, e2, a0, a2, a4, a6 = DATUMS[datum]
    kept = df.columns
    ok = F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0) & (F.abs(F.col(lat)) < 90.0)
    one = df.withColumns({"_phi": F.when(ok, F.radians(F.col(lat))), "_z": utm_zone(F.col(lon), east)})
    two = one.withColumns({"_s": F.sin("_phi"), "_w": F.radians(F.col(lon) - (F.col("_z") * 6 - 183))})
    three = two.withColumns({"_c": F.sqrt(1 - F.col("_s") * F.col("_s")), "_nu": a / F.sqrt(1 - e2 * F.col("_s") * F.col("_s")), "_rho": a * (1 - e2) / F.pow(1 - e2 * F.col("_s") * F.col("_s"), F.lit(1.5))})
    phi = F.col("_phi")
    four = three.withColumns({"_t2": F.pow(F.col("_s") / F.col("_c"), F.lit(2.0)), "_p": F.col("_nu") / F.col("_rho"), "_m": a * (a0 * phi - a2 * F.sin(2 * phi) + a4 * F.sin(4 * phi) - a6 * F.sin(6 * phi))})
    p, t2, c, w, nu, s = (F.col(x) for x in ("_p", "_t2", "_c", "_w", "_nu", "_s"))
    power = lambda x, n: F.pow(x, F.lit(float(n)))
    x = w + power(w, 3) / 6 * power(c, 2) * (p - t2)
    x = x + power(w, 5) / 120 * power(c, 4) * (4 * power(p, 3) * (1 - 6 * t2) + power(p, 2) * (1 + 8 * t2) - 2 * p * t2 + t2 * t2)
    x = x + power(w, 7) / 5040 * power(c, 6) * (61 - 479 * t2 + 179 * t2 * t2 - power(t2, 3))
    y = F.col("_m") + w * w / 2 * nu * s * c + power(w, 4) / 24 * nu * s * power(c, 3) * (4 * p * p + p - t2)
    y = y + power(w, 6) / 720 * nu * s * power(c, 5) * (8 * power(p, 4) * (11 - 24 * t2) - 28 * power(p, 3) * (1 - 6 * t2) + p * p * (1 - 32 * t2) - 2 * p * t2 + t2 * t2)
    y = y + power(w, 8) / 40320 * nu * s * power(c, 7) * (1385 - 3111 * t2 + 543 * t2 * t2 - power(t2, 3))
    south = F.col(lat) < 0
    return four.select(*kept, (500000.0 + SCALE * nu * c * x).alias(f"{prefix}x"), (SCALE * y + F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))).alias(f"{prefix}y"), F.when(phi.isNotNull(), F.when(south, -F.col("_z")).otherwise(F.col("_z"))).alias(f"{prefix}zone"))


def add_utm_by(df: DataFrame, lat: str, lon: str, datum: str, prefix: str = "utm_") -> DataFrame:
    """The same with a datum for each row, named in a column; an unknown or null name stands for the first datum."""
    kept, first = df.columns, next(iter(DATUMS))
    parts = [f"{prefix}{c}" for c in ("x", "y", "zone")]
    for name in DATUMS:
        df = add_utm(df, lat, lon, name, prefix=f"_{name}_")
    out = df
    for c in ("x", "y", "zone"):
        v = F.col(f"_{first}_{c}")
        for name in list(DATUMS)[1:]:
            v = F.when(F.lower(datum) == name, F.col(f"_{name}_{c}")).otherwise(v)
        out = out.withColumn(f"{prefix}{c}", v)
    return out.select(*kept, *parts)


def add_latlon(df: DataFrame, x: str, y: str, zone: str, datum: str = "nad27", prefix: str = "geo_") -> DataFrame:
    """The inverse: adds ``<prefix>lat`` and ``<prefix>lon``; the foot point takes a fixed number of Newton steps."""
    a, e2, a0, a2, a4, a6 = DATUMS[datum]
    kept = df.columns
    now = df.withColumns({"_y": (F.col(y) - F.when(F.col(zone) < 0, F.lit(1e7)).otherwise(F.lit(0.0))) / SCALE, "_x": (F.col(x) - 500000.0) / SCALE})
    now = now.withColumn("_f0", F.when(F.col(zone) < 0, F.lit(-0.7853981633974483)).otherwise(F.lit(0.7853981633974483)))
    for k in range(NEWTON_STEPS):
        f = F.col(f"_f{k}")
        arc = a * (a0 * f - a2 * F.sin(2 * f) + a4 * F.sin(4 * f) - a6 * F.sin(6 * f))
        slope = a * (a0 - 2 * a2 * F.cos(2 * f) + 4 * a4 * F.cos(4 * f) - 6 * a6 * F.cos(6 * f))
        now = now.withColumn(f"_f{k + 1}", f - (arc - F.col("_y")) / slope)
    f = F.col(f"_f{NEWTON_STEPS}")
    now = now.withColumns({"_s": F.sin(f), "_t": F.tan(f)})
    now = now.withColumns({"_nu": a / F.sqrt(1 - e2 * F.col("_s") * F.col("_s")), "_rho": a * (1 - e2) / F.pow(1 - e2 * F.col("_s") * F.col("_s"), F.lit(1.5))})
    now = now.withColumns({"_q": F.col("_x") / F.col("_nu"), "_p": F.col("_nu") / F.col("_rho"), "_t2": F.col("_t") * F.col("_t")})
    q, p, t2, power = F.col("_q"), F.col("_p"), F.col("_t2"), lambda v, n: F.pow(v, F.lit(float(n)))
    up = q * F.col("_x") / 2 - F.col("_x") * power(q, 3) / 24 * (-4 * p * p + 9 * p * (1 - t2) + 12 * t2)
    up = up + F.col("_x") * power(q, 5) / 720 * (8 * power(p, 4) * (11 - 24 * t2) - 12 * power(p, 3) * (21 - 71 * t2) + 15 * p * p * (15 - 98 * t2 + 15 * t2 * t2) + 180 * p * (5 * t2 - 3 * t2 * t2) + 360 * t2 * t2)
    up = up - F.col("_x") * power(q, 7) / 40320 * (1385 + 3633 * t2 + 4095 * t2 * t2 + 1575 * power(t2, 3))
    side = q - power(q, 3) / 6 * (p + 2 * t2) + power(q, 5) / 120 * (-4 * power(p, 3) * (1 - 6 * t2) + p * p * (9 - 68 * t2) + 72 * p * t2 + 24 * t2 * t2)
    side = side - power(q, 7) / 5040 * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * power(t2, 3))
    return now.select(*kept, F.degrees(f - F.col("_t") / F.col("_rho") * up).alias(f"{prefix}lat"), (F.degrees(side / F.cos(f)) + F.abs(F.col(zone)) * 6 - 183).alias(f"{prefix}lon"))


def sheet_corners(title: Column) -> Column:
    """The last map-sheet code in a title (like NL12-08W) as a struct of south-west and north-east corners and zone.

    Letters count four degrees from the equator. Southern sheets are mirrored, edge for edge.
    """
    codes = F.regexp_extract_all(title, F.lit("[NS][A-Z][0-9][0-9]-[0-9][0-9][EW]"), F.lit(0))
    code = F.try_element_at(codes, F.lit(-1))
    n = F.substring(code, 6, 2).cast("int")
    zone = F.substring(code, 3, 2).cast("int")
    low = (F.ascii(F.substring(code, 2, 1)) - 65) * 4 + 3 - F.floor((n - 1) / 3).cast("int")
    lat = F.when(F.substring(code, 1, 1) == "S", -(low + 1)).otherwise(low)
    lon = -186 + 6 * zone + 2 * F.pmod(n + 2, F.lit(3)) + F.when(F.substring(code, 8, 1) == "E", 1).otherwise(0)
    return F.when(code.isNotNull(), F.struct(lat.cast("int").alias("sw_lat"), lon.cast("int").alias("sw_lon"), (lat + 1).cast("int").alias("ne_lat"), (lon + 1).cast("int").alias("ne_lon"), zone.alias("zone")))


def quad_name(lat: Column, lon: Column) -> Column:
    """AABBBCD from a south-east corner: whole degrees, row a to h going north, column 1 to 8 going west."""
    la, lo = F.abs(lat) + 0.02, F.abs(lon) + 0.02
    row = F.char(97 + F.floor((la - F.floor(la)) * 8).cast("int"))
    col = (1 + F.floor((lo - F.floor(lo)) * 8)).cast("int").cast("string")
    return F.concat(F.lpad(F.floor(la).cast("string"), 2, "0"), F.lpad(F.floor(lo).cast("string"), 3, "0"), row, col)
