import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import attributes, grid, image, vector
from gridloom.sources import iso8211, sdts


def plain_rings(lines, area):
    """The list of an area's lines put in order by exchanging places, step by step."""
    ls = sorted((x for x in lines if x[1] != x[2] and area in (x[1], x[2])), key=lambda x: x[0])
    ends = lambda x: (x[3], x[4]) if x[2] == area else (x[4], x[3])
    if not ls:
        return []
    top = max(range(len(ls)), key=lambda k: (ls[k][5], -k))
    ls[0], ls[top] = ls[top], ls[0]
    out, j = [], 0
    while j < len(ls):
        begin, end = ends(ls[j])
        found = next((k for k in range(j + 1, len(ls)) if ends(ls[k])[0] == end), None) if begin != end else None
        if found is not None:
            ls[j + 1], ls[found] = ls[found], ls[j + 1]
        out.append(-ls[j][0] if ls[j][1] == area else ls[j][0])
        if found is None and j < len(ls) - 1:
            out.append(0)
            ls.append(ls[j + 1])
            j += 1
        j += 1
    return out


def test_rings_against_exchanges(spark):
    rng = random.Random(4)
    rows = []
    for area in range(40):
        for k in range(rng.randint(1, 12)):
            other = rng.choice([100, area])
            sides = (area, other) if rng.random() < 0.5 else (other, area)
            rows.append((area, 100 * area + k, *sides, rng.randint(1, 4), rng.randint(1, 4), float(rng.randint(0, 5))))
    rows += [(50, 1, 9, 50, 1, 2, 0.0), (50, 2, 9, 50, 2, 1, 0.0), (50, 3, 9, 50, 1, 3, 0.0), (50, 4, 9, 50, 3, 1, 0.0)]
    got = {r.area: r.ring for r in vector.assemble_rings(spark.createDataFrame(rows, "area long, id long, left_area long, right_area long, start_node long, end_node long, top double")).collect()}
    for area in {r[0] for r in rows}:
        want = plain_rings([r[1:] for r in rows if r[0] == area], area)
        assert got.get(area, []) == want
    assert got[50] == [1, 2, 3, 4]
    few = {r.area: r.islands for r in vector.islands(spark.createDataFrame([(1, [1, 0, 2, 0, 3]), (2, [1])], "area long, ring array<long>")).collect()}
    assert few == {1: 2, 2: 0}


def test_townships_and_routes(spark):
    rows = spark.createDataFrame([(1, 300, "RANGE", "11AE"), (2, 300, "TOWNSHIP", "21AN"), (3, 300, "TOWNSHIP", " 7 1/2S "), (4, 300, "RANGE", "3W"), (5, 300, "RANGE", None), (6, 1, "RANGE", "3W")], "id int, category int, label string, value string")
    assert {r.id: (r.major, r.minor) for r in attributes.decode(rows).collect()} == {1: (304, 11), 2: (302, 21), 3: (303, 4007), 4: (305, 3)}
    df = spark.createDataFrame([("US 101A",), ("I 90",), ("SR AB 7",), ("12",), ("",), (None,)], "v string")
    got = [[(t.major, t.minor) for t in r.t] if r.t is not None else None for r in df.select(attributes.route(F.col("v")).alias("t")).collect()]
    assert got[:3] == [[(173, 101), (177, 1)], [(172, 90)], [(177, 102), (174, 7)]] and not got[3] and not got[4] and not got[5]


def test_fill_by_rules(spark):
    px = spark.createDataFrame([(1, x, y, 9 if x == 2 else 0) for x in range(5) for y in range(2)], "box long, x int, y int, color int")
    attr = "array<struct<major:int,minor:int>>"
    areas = spark.createDataFrame([(1, 5, 0, 0, [(90, 100)]), (1, 6, 4, 0, [(50, 1)]), (1, 7, 3, 1, [])], f"box long, id long, x int, y int, attrs {attr}")
    assert {(r.x, r.y) for r in vector.fill_areas(px, areas, [("A", 90, -1)], 9).collect()} == {(x, y) for x in (0, 1) for y in (0, 1)}
    assert vector.areas_to_fill(areas, [("L", 90, -1)]).count() == 0
    assert {r.id for r in vector.areas_to_fill(areas, [("A", 10000, 6), ("A", 10000, 7)]).collect()} == {6}


def test_map_of_two_tiles(spark):
    f = image.Frame((41.0, -100.0, 40.0, -99.0), 8, 8)
    tiles = spark.createDataFrame([("a", 1, 40.0, -100.0, 41.0, -99.0, 9, 9), ("b", 2, 40.0, -99.5, 41.0, -98.5, 9, 9), ("c", 3, 50.0, 0.0, 51.0, 1.0, 9, 9)], "tile string, seq int, sw_lat double, sw_lon double, ne_lat double, ne_lon double, rows int, cols int")
    cells = spark.createDataFrame([(t, i, j, None if (i, j) == (4, 1) else base + i) for t, base in (("a", 100), ("b", 500), ("c", 9000)) for i in range(9) for j in range(9)], "tile string, i int, j int, elev int")
    got = {(r.i, r.j): r.elev for r in image.render(tiles, cells, f).collect()}
    assert len(got) == 81 and got[0, 0] == 100 and got[8, 8] == 508 and got[0, 4] == 500 and max(got.values()) < 1000
    assert image.render(tiles.filter("false"), cells, f).filter("elev is not null").count() == 0
    with pytest.raises(ValueError):
        image.Frame((95.0, 0.0, 0.0, 1.0), 8, 8)
    with pytest.raises(ValueError):
        image.checked(relief=2.0)
    assert (image.default_size(None), image.default_size(0.5), image.default_size(None, 1201), image.border(7, 60)) == (600, 300, 1200, 61)
    assert image.corner_label(f) == "40N, 100W to 41N, 99W" and image.contour_message(10) == "Contour interval is 10.00 meters (32.81 feet)."
    assert image.map_name(spark.createDataFrame([("BOZEMAN - W  MT   x",)], "title string")).first().name == "BOZEMAN - W  MT"
    assert image.tick_pixels(image.ticks(spark, f), f).count() > 0


def test_contours_may_leave_out_holes(spark):
    cells = spark.createDataFrame([(i, j, None if (i, j) == (2, 2) else 10) for i in range(5) for j in range(5)], "i int, j int, elev int")
    orange = lambda df: {(r.i, r.j) for r in df.filter("color = 245").collect()}
    assert orange(grid.contours(cells, 5.0)) == {(2, 2)} and orange(grid.contours(cells, 5.0, mask=True)) == set()


def test_transfer_from_files(spark, tmp_path):
    """Two modules of a transfer written as files, read back and put together."""
    b4 = lambda v: v.to_bytes(4, "big", signed=True)
    fields = {"0001": (["REC"], ["I(4)"]), "LINE": (["MODN", "RCID"], ["A", "I"]), "ATID": (["MODN", "RCID"], ["A", "I"]), "PIDL": (["MODN", "RCID"], ["A", "I"]), "PIDR": (["MODN", "RCID"], ["A", "I"]), "SNID": (["MODN", "RCID"], ["A", "I"]), "ENID": (["MODN", "RCID"], ["A", "I"]), "SADR": (["X", "Y"], ["B(32)", "B(32)"])}
    recs = [[("0001", ["%4d" % k]), ("LINE", ["LE01", k]), ("ATID", ["AHYF", 3]), ("PIDL", ["PC01", 2]), ("PIDR", ["PC01", 4]), ("SNID", ["NO01", k]), ("ENID", ["NO01", k + 1]), ("SADR", [b4(10 * k), b4(-20), b4(7), b4(8)])] for k in (1, 2)]
    (tmp_path / "HY01LE01.DDF").write_bytes(iso8211.build(fields, recs, repeat=("SADR",)))
    iref = {"0001": (["REC"], ["I(4)"]), "IREF": (["MODN", "RCID", "SFAX", "SFAY", "XORG", "YORG"], ["A", "I", "R", "R", "R", "R"])}
    (tmp_path / "HY01IREF.DDF").write_bytes(iso8211.build(iref, [[("0001", ["   1"]), ("IREF", ["IREF", 1, "0.5", "0.25", "100.0", "200.0"])]]))
    sub = sdts.transfers(iso8211.read(spark, str(tmp_path / "*.DDF")))
    got = {r.id: r for r in sdts.lines(sub).collect()}
    assert set(got) == {1, 2} and [(p.x, p.y) for p in got[2].pts] == [(110.0, 195.0), (103.5, 202.0)]
    assert (got[1].left_area, got[1].right_area, got[1].start_node, got[1].end_node) == (2, 4, 1, 2)
    assert [tuple(r)[1:] for r in sdts.links(sub, "LE", "LINE").orderBy("id").collect()] == [(1, 0, "AHYF", 3), (2, 0, "AHYF", 3)]
    assert sdts.lines(sub.filter("false")).count() == 0 and sdts.dem_meta(sub.filter("false")).count() == 0
    bad = sdts.rejects(sdts.dem_meta(sub)).first()
    assert "title" in bad.reason


def test_models_out_of_tiles_and_back(spark, tmp_path):
    import zipfile

    from gridloom.sources import dem, sinks

    cells = spark.createDataFrame([("a.dem", i, j, None if (i + j) % 5 == 0 else 10 * i + j) for i in range(3) for j in range(4)], "file string, i int, j int, elev int")
    heads = spark.createDataFrame([("a.dem", "BOZEMAN", 12, 480000.0, 5066000.0, 30.0)], "file string, title string, zone int, x0 double, y0 double, res double")
    done = sinks.write_files(dem.encode_tiles(cells, heads), str(tmp_path)).collect()
    assert done[0].bytes == (tmp_path / "a.dem").stat().st_size
    back = dem.to_cells(dem.read_profiles(spark, str(tmp_path / "a.dem")), dem.read_headers(spark, str(tmp_path / "a.dem")))
    assert {(r.i, r.j): r.elev for r in back.collect()} == {(r.i, r.j): r.elev for r in cells.collect()}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.dem", "a.dem")
    assert iso8211.unpack((tmp_path / "a.zip").read_bytes()) == (tmp_path / "a.dem").read_bytes()
    text = sinks.scene(0, 700, "a.pgm")
    assert "[ 0.000001 Band0 ]" in text and "Band2 ]" in text and "Band3 ]" not in text
    sinks.write_lines(spark.createDataFrame([("x|y",)], "raw string"), str(tmp_path / "names"))
    assert [r.value for r in spark.read.text(str(tmp_path / "names")).collect()] == ["x|y"]
    with pytest.raises(ValueError):
        dem.one_degree("NONE", 1201, 1201)


def test_one_degree_models(spark, tmp_path):
    """A model of 401 columns and 1201 rows, constant along a column."""
    from gridloom.sources import dem

    data = bytearray(dem.encode("BOZEMAN NL12-08W", 0, 0.0, 0.0, 3.0, [[9 * j for j in range(401)] for _ in range(1201)]))
    data[156:162] = b"     0"
    (tmp_path / "one.dem").write_bytes(bytes(data))
    tiles, cells = dem.read_one_degree(spark, str(tmp_path / "one.dem"))
    assert tiles.select("rows", "cols", (F.col("ne_lat") - F.col("sw_lat")).alias("d")).first() == (1201, 1201, 1.0)
    got = cells.agg(F.count("*"), F.max("j"), F.max("i"), F.min(F.when(F.col("j") == 4, F.col("elev"))), F.max(F.when(F.col("j") == 4, F.col("elev")))).first()
    assert tuple(got) == (1201 * 1201, 1200, 1200, 12, 12)


def test_cursors_are_neither_broadcast_nor_split_by_null_ids(spark):
    """The crosses are 13 times the points, which Spark's estimate of an explode leaves out."""
    points = spark.createDataFrame([(1, 5, 5), (None, 20, 20)], "id long, x int, y int")
    pixels = spark.createDataFrame([(x, y, color.WHITE if (x, y) == (22, 20) else 3) for x in range(30) for y in range(30)], "x int, y int, color int")
    df = image.cursors(points, pixels)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    assert {r.id for r in got} == {1, None} and len(got) == 26
    assert {(r.id, r.color) for r in got} == {(1, color.WHITE), (None, color.BLACK)}


def test_counts_take_no_values_along(spark):
    """The rows of lines, nodes, areas and links, on records that lack numbers, points or a frame, without lists or sorting."""
    rng = random.Random(3)
    rows = [(f, "IREF", 1, 0, "IREF", k, "R", b"1") for f in ("a", "b") for k in ("SFAX", "SFAY", "XORG", "YORG")]
    for f in ("a", "b", "c"):
        for n, module in enumerate(("LE01", "LE02", "NO01", "NE01", "NA01", "NP01", "PC01")):
            for rec in range(1, 9):
                tag = rng.choice(("LINE", "PNTS")) if module != "NE01" else "PNTS"
                kinds = [(tag, "RCID", "I", rng.choice((b"1", b"7", b"x", b"2.5")))] * rng.randint(0, 2)
                kinds += [("SADR", rng.choice("XY"), rng.choice(("I", "A")), b"5") for _ in range(rng.randint(0, 4))]
                kinds += [("ATID", rng.choice(("MODN", "RCID")), rng.choice("AI"), b"3") for _ in range(rng.randint(0, 4))]
                rows += [(f, module, rec, seq, *k) for seq, k in enumerate(kinds)]
    sub = spark.createDataFrame(rows, "file string, module string, rec int, seq int, tag string, label string, format string, value binary")
    n = lambda df: {r[0]: r[1] for r in df.groupBy("file").count().collect()}
    parts = [n(sdts.lines(sub)), n(sdts.nodes(sub)), n(sdts.areas(sub)), n(sdts.lines(sub).select("file", F.explode("pts"))), n(sdts.links(sub, "LE", "LINE"))]
    df = sdts.counts(sub)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert {tuple(r) for r in df.collect()} == {(f, *(p.get(f, 0) for p in parts)) for f in parts[0]} and set(parts[0]) == {"a", "b"}
