"""Place names in three encodings, told apart by their content, and box search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dms_to_degrees, lenient_number


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text (gzip too) as ``raw``."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def parse(rows: DataFrame) -> DataFrame:
    """Adds ``fmt, name, class, state, lat, lon, reason`` to rows with ``raw``; reason says why a record is no good."""
    raw = F.col("raw")
    fmt = F.when(raw.contains('","'), "quoted").when(raw.contains("|"), "piped").otherwise("fixed")
    quoted, piped = F.split(F.regexp_replace(raw, '^"|"\\s*$', ""), '","'), F.split(raw, "\\|")
    field = lambda a, k: F.get(a, F.lit(k))
    pick = lambda q, p, f: F.when(F.col("fmt") == "quoted", q).when(F.col("fmt") == "piped", p).otherwise(f)
    sub = lambda at, n: F.trim(F.substring(raw, at, n))
    lat, lon = dms_to_degrees(F.substring(raw, 81, 7), 2), dms_to_degrees(F.substring(raw, 89, 8), 3)
    reason = (
        F.when((F.col("fmt") == "quoted") & (F.size(quoted) < 10), "fewer than 10 fields")
        .when((F.col("fmt") == "piped") & (F.size(piped) < 11), "fewer than 11 fields")
        .when((F.col("fmt") == "piped") & (field(piped, 0) == "FEATURE_ID"), "header")
        .when((F.col("fmt") == "fixed") & (F.length(raw) < 96), "short record")
        .when((F.col("fmt") == "fixed") & (lat.isNull() | lon.isNull()), "no hemisphere")
    )
    now = rows.withColumn("fmt", fmt).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return now.withColumns({
        "name": pick(field(quoted, 1), field(piped, 1), sub(4, 51)),
        "class": pick(field(quoted, 2), field(piped, 2), sub(55, 26)),
        "state": pick(field(quoted, 0), field(piped, 3), sub(1, 2)),
        "lat": F.when(ok, pick(lenient_number(field(quoted, 8)), lenient_number(field(piped, 9)), lat)),
        "lon": F.when(ok, pick(lenient_number(field(quoted, 9)), lenient_number(field(piped, 10)), lon)),
    })


def search(places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Places inside the box of two opposite corners (lat, lon, lat, lon), all edges included; corners in any order."""
    a, b, c, d = map(float, box)
    if not (abs(a) <= 90 and abs(c) <= 90 and abs(b) <= 180 and abs(d) <= 180):
        raise ValueError("latitudes are within 90 degrees, longitudes within 180")
    return places.filter(F.col("lat").between(min(a, c), max(a, c)) & F.col("lon").between(min(b, d), max(b, d)))
