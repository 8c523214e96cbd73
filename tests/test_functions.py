import pytest
from pyspark.sql import functions as F

from gridloom.functions import color, geodesy, text
from gridloom.operators import attributes
from gridloom.sources import gnis

CORNERS = [(45.75, -112.0, 422218.03, 5066539.80), (46.0, -112.0, 422565.07, 5094315.16), (46.0, -111.75, 441923.83, 5094103.38), (45.75, -111.75, 441663.14, 5066327.07), (45.75, -111.25, 480554.09, 5066083.19)]


def test_projection_control_points(spark):
    df = geodesy.add_utm(spark.createDataFrame(CORNERS, "lat double, lon double, x double, y double"), "lat", "lon")
    for r in df.collect():
        assert abs(r.utm_x - r.x) < 1 and abs(r.utm_y - r.y) < 1 and r.utm_zone == 12


def test_projection_round_trip_and_poles(spark):
    pts = [(float(a), -120 + a * 0.7) for a in range(-80, 81, 7)] + [(90.0, 0.0), (-91.0, 0.0), (None, 1.0)]
    df = geodesy.add_latlon(geodesy.add_utm(spark.createDataFrame(pts, "lat double, lon double"), "lat", "lon", "wgs84"), "utm_x", "utm_y", "utm_zone", "wgs84")
    rows = df.collect()
    for r in rows[:-3]:
        assert abs(r.geo_lat - r.lat) < 1e-9 and abs(r.geo_lon - r.lon) < 1e-9
    assert all(r.utm_x is None for r in rows[-3:])


def test_zone_edges(spark):
    df = spark.createDataFrame([(-180.0,), (180.0,), (-174.0,)], "lon double").select(geodesy.utm_zone(F.col("lon")).alias("w"), geodesy.utm_zone(F.col("lon"), True).alias("e"))
    assert [tuple(r) for r in df.collect()] == [(1, 1), (60, 60), (1, 2)]


def test_sheet_code(spark):
    r = spark.createDataFrame([("BOZEMAN NL12-08W",), ("none",)], "t string").select(geodesy.sheet_corners(F.col("t")).alias("c")).collect()
    assert tuple(r[0].c) == (45, -112, 46, -111, 12) and r[1].c is None


def test_text(spark):
    r = spark.sql("select '464828N' a, '1141302W' b, '12.5x' c, 'x' d, '1.5D+02' e").select(text.dms_to_degrees(F.col("a"), 2).alias("a"), text.dms_to_degrees(F.col("b"), 3).alias("b"), text.lenient_number(F.col("c")).alias("c"), text.lenient_number(F.col("d")).alias("d"), text.d_exponent(F.col("e")).alias("e")).first()
    assert r.a == pytest.approx(46.80777777) and r.b == pytest.approx(-114.21722222) and (r.c, r.d, r.e) == (12.5, 0.0, 150.0)
    s = spark.sql("select -0.5D v").select(text.degrees_to_dms(F.col("v")).alias("t")).first().t
    assert (s.sign, s.deg, s.min) == (-1, 0, 30)


FIXED = "MT Blue Mountain Saddle                               locale    Missoula                 464828N 1141302W                    5640 Blue Mountain"
NAMES = [
    '"MT","Blue Mountain Saddle","locale","Missoula","30","063","464828N","1141302W","46.80778","-114.21722","","","","","5640","","Blue Mountain"',
    "794295|Blue Mountain Saddle|Locale|MT|30|Missoula|063|464828N|1141305W|46.8077009|-114.2181696|||||1723|5653|Blue Mountain|12/01/1991|",
    "FEATURE_ID|FEATURE_NAME|CLASS|a|b|c|d|e|f|g|h|i", '"a","b"', "too short",
]


def test_place_names(spark):
    rows = gnis.parse(spark.createDataFrame([(x,) for x in [f"{'MT Blue Mountain Saddle':54}{'locale':26}464828N 1141302W", *NAMES]], "raw string"))
    got = rows.collect()
    assert [r["name"] for r in got[:3]] == ["Blue Mountain Saddle"] * 3
    assert got[0].lat == pytest.approx(46.8077777) and got[1].lon == -114.21722 and got[2].lat == 46.8077009
    assert [r.reason is None for r in got] == [True, True, True, False, False, False]
    assert gnis.search(rows, (47, -114, 46, -115)).count() == 3
    with pytest.raises(ValueError):
        gnis.search(rows, (95, 0, 0, 0))


def test_attribute_kinds(spark):
    cases = [(20, "SUPPLEMENTARY", "Y", [(20, 202)]), (20, "SUPPLEMENTARY", "N", []), (170, "RELATION_TO_GROUND", "D", [(170, 612)]), (170, "LANES", " 4", [(171, 4)]), (170, "LANES", "-99", []), (170, "ROAD_WIDTH", "24", [(170, 624)]), (50, "ELEVATION", "-12.6", [(57, 13)]), (50, "ELEVATION", "-9999.99", []), (150, "ELEVATION", "12.4", [(154, 12)]), (50, "RIVER_MILE", "3.5", [(55, 4)]), (90, "TOWNSHIP_CODE", "12345", [(93, 12), (94, 345)]), (90, "MONUMENT_NUMBER", "7", [(95, 7)]), (300, "RANGE", "10 1/2E", [(304, 4010)]), (300, "RANGE", "1AE", [(304, 1)]), (300, "TOWNSHIP", "3S", [(303, 3)]), (1, "NOTHING", "Y", [])]
    df = spark.createDataFrame([(k, c, lab, v) for k, (c, lab, v, _) in enumerate(cases)], "id int, category int, label string, value string")
    got = {}
    for r in attributes.decode(df).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.major, r.minor))
    for k, (*_, want) in enumerate(cases):
        assert got.get(k, []) == want, cases[k]


def test_routes(spark):
    r = spark.createDataFrame([("I 90",), ("US 191",), ("SR 85",), ("A",), ("CR BC",)], "v string").select(attributes.route(F.col("v")).alias("r")).collect()
    assert [[(t.major, t.minor) for t in x.r] for x in r] == [[(172, 90)], [(173, 191)], [(174, 85)], [(177, 1)], [(177, 203), (176, 0)]]


def test_ramp_and_bands(spark):
    ramp = {r.idx: (r.r, r.g, r.b) for r in color.shade_ramp(spark, 2, 0.5).collect()}
    assert len(ramp) == 256 and ramp[0] == (190, 255, 175) and ramp[15] == (95, 127, 87)
    assert color.stretched(-50, 1400)[0] == 100 and color.stretched(-50, 1400)[-1] == 32000
