"""Feature attributes: named subfields into (major, minor) codes, by a dictionary and the kind of each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, category, major, name, minor (-1: comes from the value).
FEATURES = (
    (0, 20, 20, "SUPPLEMENTARY", 202), (1, 20, 20, "AMENDED", 204), (2, 20, 20, "APPROXIMATE", 610), (3, 20, 20, "DEPRESSION", 611),
    (4, 20, 20, "GLACIER_OR_SNOW", 612), (5, 20, 20, "UNDERWATER", 613), (6, 20, 20, "BEST_ESTIMATE", 614), (7, 20, 26, "SPOT_CATEGORY", -1),
    (8, 20, 26, "PHOTOREVISED", 0), (9, 50, 50, "PHOTOREVISED", 0), (10, 50, 50, "RELATION_TO_GROUND", -1), (11, 50, 50, "VERTICAL_RELATION", -1),
    (12, 50, 50, "BANK", -1), (13, 50, 50, "OPERATIONAL_STATUS", -1), (14, 50, 50, "SALT", 608), (15, 50, 50, "UNSURVEYED", 609),
    (16, 50, 50, "INTERMITTENT", 610), (17, 50, 50, "SUBMERGED", 612), (18, 50, 50, "DRY", 614), (19, 50, 50, "MINERAL_OR_HOT", 615),
    (20, 50, 50, "NAVIGABLE", 616), (21, 50, 50, "EARTHEN", 618), (22, 50, 50, "INTERPOLATED", 619), (23, 50, -1, "ELEVATION", -1),
    (24, 50, 53, "ROTATION_ANGLE", -1), (25, 50, 55, "RIVER_MILE", -1), (26, 50, 58, "BEST_ESTIMATE", 0), (27, 70, 78, "BEST_ESTIMATE", 0),
    (28, 80, 80, "PHOTOREVISED", 0), (29, 80, 88, "BEST_ESTIMATE", 0), (30, 90, 90, "CIVIL_TOWNSHIP", 100), (31, 90, 90, "CITY", 101),
    (32, 90, 90, "NATIONAL_FOREST", 104), (33, 90, 90, "WILDERNESS_AREA", 106), (34, 90, 90, "AHUPUAA", 135), (35, 90, 90, "HAWAIIAN_HOMESTEAD", 136),
    (36, 90, 90, "FEDERALLY_ADMIN", 401), (37, 90, 90, "IN_DISPUTE", 601), (38, 90, 91, "STATE", -1), (39, 90, 92, "COUNTY", -1),
    (40, 90, -1, "TOWNSHIP_CODE", -1), (41, 90, 90, "PHOTOREVISED", 0), (42, 90, -1, "MONUMENT_NUMBER", -1), (43, 90, 98, "BEST_ESTIMATE", 0),
    (44, 150, 151, "STATE", -1), (45, 150, 152, "COUNTY", -1), (46, 150, -1, "ELEVATION", -1), (47, 170, 170, "ARBITRARY_EXT", 216),
    (48, 170, 170, "RELATION_TO_GROUND", -1), (49, 170, 170, "VERTICAL_RELATION", -1), (50, 170, 170, "OPERATIONAL_STATUS", -1), (51, 170, 170, "ACCESS_RESTRICTION", -1),
    (52, 170, 170, "OLD_RAILROAD_GRADE", 605), (53, 170, 170, "WITH_RAILROAD", 623), (54, 170, 170, "COVERED", 624), (55, 170, 170, "HISTORICAL", 600),
    (56, 170, 170, "LIMITED_ACCESS", 608), (57, 170, 170, "PHOTOREVISED", 0), (58, 170, 171, "LANES", -1), (59, 170, 170, "ROAD_WIDTH", -1),
    (60, 170, 178, "BEST_ESTIMATE", 0), (61, 180, 180, "RELATION_TO_GROUND", -1), (62, 180, 180, "VERTICAL_RELATION", -1), (63, 180, 180, "OPERATIONAL_STATUS", -1),
    (64, 180, 180, "ACCESS_RESTRICTIONS", -1), (65, 180, 180, "NARROW_GAUGE", 606), (66, 180, 180, "IN_SNOWSHED", 607), (67, 180, 180, "RAPID_TRANSIT", 610),
    (68, 180, 180, "JUXTAPOSITION", 614), (69, 180, 180, "ARBITRARY_EXT", 210), (70, 180, 180, "HISTORICAL", 600), (71, 180, 180, "PHOTOREVISED", 0),
    (72, 180, 181, "TRACKS", -1), (73, 180, 183, "ROTATION_ANGLE", -1), (74, 180, 188, "BEST_ESTIMATE", 0), (75, 190, 190, "RELATION_TO_GROUND", -1),
    (76, 190, 190, "OPERATIONAL_STATUS", -1), (77, 190, 190, "UNIMPROVED", 605), (78, 190, 190, "NUCLEAR", 607), (79, 190, 190, "ARBITRARY_EXT", 205),
    (80, 190, 190, "PHOTOREVISED", 0), (81, 190, 193, "ROTATION_ANGLE", -1), (82, 190, 198, "BEST_ESTIMATE", 0), (83, 190, 196, "STATE", -1),
    (84, 190, 197, "AIRPORT", -1), (85, 200, 200, "RELATION_TO_GROUND", -1), (86, 200, 200, "OPERATIONAL_STATUS", -1), (87, 200, 200, "PRODUCT", -1),
    (88, 200, 200, "COVERED", 608), (89, 200, 200, "TOWER_TYPE", -1), (90, 200, 200, "UNINCORPORATED", 615), (91, 200, 200, "NO_POPULATION", 616),
    (92, 200, 200, "NATIONAL_CAPITAL", 690), (93, 200, 200, "STATE_CAPITAL", 691), (94, 200, 200, "COUNTY_SEAT", 692), (95, 200, 200, "POPULATION_CLASS", -1),
    (96, 200, 200, "PHOTOREVISED", 0), (97, 200, 202, "WIDTH", -1), (98, 200, 203, "ROTATION_ANGLE", -1), (99, 200, 208, "BEST_ESTIMATE", 0),
    (100, 200, 206, "STATE", -1), (101, 200, 207, "POPULATED_PLACE", -1), (102, 300, 300, "ID_IN_FIELD", 40), (103, 300, 300, "WITH_HORIZONTAL", 41),
    (104, 300, 300, "WITH_ELEVATION", 42), (105, 300, 300, "APPROXIMATE_POS", 201), (106, 300, 300, "PROTRACTED_POS", 202), (107, 300, 306, "ORIGIN_OF_SURVEY", -1),
    (108, 300, -1, "TOWNSHIP", -1), (109, 300, -1, "RANGE", -1), (110, 300, 301, "SECTION", -1), (111, 300, 307, "LAND_GRANT", -1),
    (112, 300, -1, "MONUMENT_NUMBER", -1), (113, 300, 308, "BEST_ESTIMATE", 0), (114, 300, 306, "OHIO_NAMED_SURVEY", -1), (115, 300, 300, "REFUGEE_LANDS", 612),
    (116, 190, 190, "UNPAVED", 605),
)
# Letters of coded entries.
LETTERS = {
    10: "U601 E603 T604", 11: "O602 U617", 12: "R605 L606", 13: "U607 A611", 48: "T601 S606 D612 E614 R618", 49: "O602 U607", 50: "U603 X604 P611", 51: "T609 P610",
    61: "T601 E609 R611", 62: "O602 U605", 63: "A603 D604 U608", 64: "P612 G613", 75: "U600 A603 S606", 76: "U601 A602 C604", 85: "U601 S617", 86: "C602 A603 R618",
    87: "W604 O605 G606 C607 V609 S610 L611 B612 A619 H620 I621 P622 E623 R624", 89: "R613 L614",
}
# What says nothing, added numbers, codes of elevations and monuments, of routes and their types, and themes.
BLANKS = ("", "-9", "-99", "-999", "-999.99", "-9999.99")
OFFSETS = {59: 600, 95: 680}
ELEVATIONS = {23: (52, 57), 46: (154, 157)}
MONUMENTS = {42: 95, 112: 308}
ROUTES = (("I", 172), ("US", 173), ("SR", 174), ("RR", 175), ("CR", 176))
ROUTE_TYPES = (("Bypass", 615), ("Alternate", 616), ("Business", 617), ("Spur", 619), ("Loop", 620), ("Connector", 621), ("Truck", 622))
THEMES = (("BOUNDAR", 90), ("HYDROGRAPHY", 50), ("HYPSOGRAPHY", 20), ("ROADS", 170), ("RAIL", 180), ("PIPE", 190), ("VEGETATI", 70), ("NON-VEG", 80), ("MANMADE", 200), ("SURVEY CONTROL", 150), ("PUBLIC LAND", 300), ("U.S. PUBLIC", 300))


def kind_of(key: int, minor: int) -> str:
    if key in LETTERS:
        return "letter"
    if key in OFFSETS:
        return "offset"
    if key in ELEVATIONS:
        return "elevation"
    if key in MONUMENTS:
        return "monument"
    return {25: "rounded", 40: "split", 108: "township", 109: "range"}.get(key, "flag" if minor >= 0 else "integer")


ENTRY = "category int, entries array<struct<key:int,name:string,kind:string,major:int,minor:int,up:int,down:int,letters:map<string,int>>>"


def dictionary(spark: SparkSession) -> DataFrame:
    """A row per category with its entries in order: a table to broadcast, of one size whatever the data."""
    by: dict[int, list] = {}
    for key, category, major, name, minor in FEATURES:
        kind = kind_of(key, minor)
        up, down = ELEVATIONS.get(key, (MONUMENTS.get(key, major), None))
        letters = {t[0]: int(t[1:]) for t in LETTERS.get(key, "").split()}
        by.setdefault(category, []).append((key, name, kind, 93 if kind == "split" else up if kind in ("elevation", "monument") else major, OFFSETS.get(key, minor), up, down, letters))
    return spark.createDataFrame(sorted(by.items()), ENTRY)


def _decoded(e: Column, v: Column) -> Column:
    """array<struct<major, minor>> of a value under an entry; null where the value says nothing."""
    kind, n, real = e["kind"], F.regexp_extract(v, r"^[-+]?\d+", 0).try_cast("int"), v.try_cast("double")
    good = ~v.isin(*BLANKS)
    pair = lambda a, b: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"))
    part = F.regexp_extract(v, r"^[-+]?\d+ ([123]/[24])", 1)
    side = F.regexp_extract(v, r"^[-+]?\d+(?: (?:1/4|1/2|3/4))? *(.?)", 1)
    quarters = F.when(part == "1/4", 2000).when(part == "1/2", 4000).when(part == "3/4", 6000).otherwise(0)
    code = F.try_element_at(e["letters"], F.substring(v, 1, 1))
    number, decimal = good & n.isNotNull(), good & real.isNotNull()
    return (
        F.when((kind == "flag") & v.startswith("Y"), F.array(pair(e["major"], e["minor"])))
        .when((kind == "letter") & code.isNotNull(), F.array(pair(e["major"], code)))
        .when((kind == "offset") & number, F.array(pair(e["major"], n + e["minor"])))
        .when((kind == "elevation") & decimal, F.array(pair(F.when(real < 0, e["down"]).otherwise(e["up"]), F.round(F.abs(real)))))
        .when((kind == "rounded") & decimal, F.array(pair(e["major"], F.round(real))))
        .when((kind == "split") & number, F.array(pair(F.lit(93), F.floor(n / 1000)), pair(F.lit(94), n % 1000)))
        .when((kind == "township") & number, F.array(pair(F.when(side == "S", 303).otherwise(302), n + quarters)))
        .when((kind == "range") & number, F.array(pair(F.when(side == "W", 305).otherwise(304), n + quarters)))
        .when(kind.isin("integer", "monument") & number, F.array(pair(e["major"], n)))
    )


def decode(rows: DataFrame) -> DataFrame:
    """``(..., category, label, value)`` -> its other columns and ``(seq, major, minor)``.

    A label belongs to the first entry of its category whose name it begins with. The dictionary is broadcast.
    """
    rest = [c for c in rows.columns if c not in ("category", "label", "value")]
    met = rows.join(F.broadcast(dictionary(rows.sparkSession)), "category")
    entry = met.select(*rest, F.trim("value").alias("v"), F.get(F.filter("entries", lambda x: F.col("label").startswith(x["name"])), F.lit(0)).alias("e"))
    return entry.filter("e is not null").select(*rest, F.posexplode(_decoded(F.col("e"), F.col("v"))).alias("seq", "t")).select(*rest, "seq", "t.major", "t.minor")


def entity_label(label: Column) -> Column:
    """Seven characters: three of the major, four of the minor code."""
    return F.struct(F.substring(label, 1, 3).try_cast("int").alias("major"), F.substring(label, 4, 4).try_cast("int").alias("minor"))


def _letters(s: Column) -> Column:
    """A = 1; two letters are 100 * a + b."""
    one = F.ascii(s) - 64
    return F.when(F.length(s) == 1, one).when(F.length(s) == 2, one * 100 + F.ascii(F.substring(s, 2, 1)) - 64)


def route(value: Column) -> Column:
    """array<struct<major, minor>> of a route: its jurisdiction with the number, and the number's letters as 177.

    Letters behind a number come second, letters ahead of one come first; a jurisdiction without a number has 0. A
    text without a jurisdiction gives its letters alone.
    """
    v = F.trim(value)
    major, tail = F.lit(None).cast("int"), v
    for name, code in reversed(ROUTES):
        here = F.instr(v, name) > 0
        major = F.when(here, F.lit(code)).otherwise(major)
        tail = F.when(here, F.trim(F.substring(v, F.instr(v, name) + len(name), F.length(v)))).otherwise(tail)
    n = F.coalesce(F.regexp_extract(tail, r"^[A-Z]{0,2} *(\d+)", 1).try_cast("int"), F.lit(0))
    front, back = _letters(F.regexp_extract(tail, r"^([A-Z]{1,2})", 1)), _letters(F.regexp_extract(tail, r"^\d+ *([A-Z]{1,2})", 1))
    pair = lambda a, b: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"))
    return F.filter(F.array(pair(F.lit(177), front), pair(major, n), pair(F.lit(177), back)), lambda t: t["major"].isNotNull() & t["minor"].isNotNull())


def route_type(value: Column) -> Column:
    """170 and the code of a kind of route; null for another word."""
    out = F.lit(None).cast("int")
    for word, code in ROUTE_TYPES:
        out = F.when(value.startswith(word), F.lit(code)).otherwise(out)
    return F.when(out.isNotNull(), F.struct(F.lit(170).alias("major"), out.alias("minor")))


def coincident(category: Column, number: Column) -> Column:
    """Features that coincide have the major of their theme plus 9."""
    return F.struct((category + 9).cast("int").alias("major"), number.cast("int").alias("minor"))


def elevation_metres(v: Column) -> Column:
    """Codes 24 (up) and 25 (down) of metres."""
    return F.struct(F.when(v < 0, 25).otherwise(24).alias("major"), F.round(F.abs(v)).cast("int").alias("minor"))


def elevation_feet(v: Column) -> Column:
    """Codes 22, 21 with 10,000 taken off above 9,999, and 23 below zero."""
    n = F.round(F.abs(v)).cast("int")
    return F.struct(F.when(v < 0, 23).when(n > 9999, 21).otherwise(22).alias("major"), F.when((v >= 0) & (n > 9999), n - 10000).otherwise(n).alias("minor"))


def theme_category(theme: Column) -> Column:
    out = F.lit(None).cast("int")
    for word, category in reversed(THEMES):
        out = F.when(F.upper(theme).contains(word), F.lit(category)).otherwise(out)
    return out
