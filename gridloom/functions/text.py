"""Numbers and angles out of fixed and loose text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def lenient_number(s: Column) -> Column:
    """The longest numeric prefix, or 0."""
    return F.coalesce(F.trim(F.regexp_extract(s, NUMBER, 0)).try_cast("double"), F.lit(0.0))


def d_exponent(s: Column) -> Column:
    """A number whose exponent may be written with D; null if it is none."""
    return F.trim(F.translate(s, "Dd", "Ee")).try_cast("double")


def dms_to_degrees(s: Column, degree_digits: int) -> Column:
    """DDMMSSH or DDDMMSSH with H one of N, S, E, W; null where the shape is another."""
    d = degree_digits
    num = lambda at, n: F.substring(s, at, n).try_cast("double")
    value = num(1, d) + num(d + 1, 2) / 60.0 + num(d + 3, 2) / 3600.0
    return F.when(F.substring(s, d + 5, 1).isin("S", "W"), -value).when(F.substring(s, d + 5, 1).isin("N", "E"), value)


def degrees_to_dms(v: Column) -> Column:
    """Truncated degrees, minutes, seconds and the sign on its own, so that it isn't lost below one degree."""
    a = F.abs(v)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    return F.struct(F.when(v < 0, -1).otherwise(1).alias("sign"), d.cast("int").alias("deg"), m.cast("int").alias("min"), (((a - d) * 60 - m) * 60).alias("sec"))
