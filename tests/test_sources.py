import gzip

import pytest
from pyspark.sql import functions as F

from gridloom.sources import dem, dispatch, graph, iso8211, sinks
from gridloom.streaming import places


def test_iso8211_round_trip(spark, tmp_path):
    fields = {"0001": (["REC"], ["I(4)"]), "LINE": (["MODN", "RCID"], ["A", "I"]), "SADR": (["X", "Y"], ["B(32)", "B(32)"])}
    xy = [(1).to_bytes(4, "big"), (2).to_bytes(4, "big"), (30).to_bytes(4, "big"), (31).to_bytes(4, "big")]
    data = iso8211.build(fields, [[("0001", ["   1"]), ("LINE", ["LE01", 7]), ("SADR", xy)]], repeat=("SADR",))
    (tmp_path / "LE01.DDF").write_bytes(data)
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "LE01.DDF.gz").write_bytes(gzip.compress(data))
    want = [("LINE", "MODN", b"LE01"), ("LINE", "RCID", b"7"), ("SADR", "X", xy[0]), ("SADR", "Y", xy[1]), ("SADR", "X", xy[2]), ("SADR", "Y", xy[3])]
    for path in (tmp_path / "LE01.DDF", tmp_path / "gz"):
        got = iso8211.read(spark, str(path)).filter("tag <> '0001'").orderBy("seq").collect()
        assert [(r.tag, r.label, bytes(r.value)) for r in got] == want and got[0].module == "LE01"
    assert iso8211.expand_formats("((A,2I(5)),B(16))") == ["A", "I(5)", "I(5)", "B(16)"]


def test_classic_model_round_trip(spark, tmp_path):
    g = [[(i * 40 + j * 3) if (i + j) % 7 else None for j in range(4)] for i in range(200)]
    data = dem.encode("BOZEMAN", 12, 480000.0, 5066000.0, 30.0, g)
    (tmp_path / "a.dem").write_bytes(data)
    (tmp_path / "b.dem").write_bytes(gzip.compress(dem.unblock(data)))
    head = dem.read_headers(spark, str(tmp_path / "*.dem"))
    assert {(r.title, r.cols, r.zone, r.x_res) for r in head.collect()} == {("BOZEMAN", 4, 12, 30.0)}
    cells = dem.to_cells(dem.read_profiles(spark, str(tmp_path / "*.dem")), head).collect()
    for name in ("a.dem", "b.dem"):
        got = {(r.i, r.j): r.elev for r in cells if r.file.endswith(name)}
        assert got == {(i, j): v for i, r in enumerate(g) for j, v in enumerate(r)}
    with pytest.raises(ValueError):
        dem.unblock(b"a\nb")
    assert dem.unblock_graph(b"x" * 160)[79::80] == b"\n\n"


HDR = "BYTEORDER M\nLAYOUT BIL\nNROWS 3\nNCOLS 4\nNBANDS 1\nNBITS 16\nBANDROWBYTES 8\nTOTALROWBYTES 8\nNODATA -9999\nULXMAP -99.75\nULYMAP 39.75\nXDIM 0.5\nYDIM 0.5\n"


def test_tile(spark, tmp_path):
    import struct

    vals = list(range(10)) + [-9999, 11]
    (tmp_path / "t.hdr").write_text(HDR)
    (tmp_path / "t.dem").write_bytes(struct.pack(">12h", *vals))
    head = dem.tile_header(HDR)
    assert (head["nw_lat"], head["nw_lon"], head["se_lat"]) == (40.0, -100.0, 39.0)
    got = {(r.i, r.j): r.elev for r in dem.read_tile(spark, str(tmp_path / "t.hdr"), str(tmp_path / "t.dem"), (1, 3, 1, 4)).collect()}
    assert got == {(1, 1): 5, (1, 2): 6, (1, 3): 7, (2, 1): 9, (2, 2): 0, (2, 3): 11}
    cells = lambda window: {(r.i, r.j): r.elev for r in dem.read_tile(spark, str(tmp_path / "t.hdr"), str(tmp_path / "t.dem"), window, True).collect()}
    grid = [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 11]]
    assert dem.tile_window(head, 39.7, -99.6, 41.0, -99.0) == (0, 1, 1, 2) and dem.tile_window(head, 40.0, -100.0, 41.0, -99.0) is None
    assert dem.tile_window(head, 39.5, -100.0, 40.0, -98.0) == (0, 2, 0, 4)  # 3 rows on one degree: 1.5 goes away from zero
    assert cells((0, 2, 1, 3)) == {(i, j): grid[i][j] for i in (0, 1, 2) for j in (1, 2, 3)}
    assert cells(None) == {(i, j): grid[min(i, 2)][min(j, 3)] for i in range(4) for j in range(5)} and cells((2, 2, 0, 4)) == {}
    with pytest.raises(ValueError):
        dem.tile_header(HDR.replace("NBITS 16", "NBITS 12"))


def test_line_graph_round_trip(spark, tmp_path):
    attrs = [(50, 400 + k) for k in range(8)]
    lines = [(1, 1, 2, 3, 4, [(10.7, 20.2), (30.0, 40.0), (50.0, 60.0), (70.0, 80.0)], attrs), (2, 2, 1, 4, 3, [(1.0, 2.0), (3.0, 4.0)], [])]
    (tmp_path / "g.opt").write_bytes(graph.encode("QUAD", [(1, 5.5, 6.5, [])], [(3, 7.0, 8.0, [(90, 101)])], lines))
    rows = {(r.kind, r.id): r for r in graph.read(spark, str(tmp_path / "g.opt")).collect()}
    assert [(a.major, a.minor) for a in rows["L", 1].attrs] == attrs
    assert [(p.x, p.y) for p in rows["L", 1].pts] == [(10.0, 20.0), (30.0, 40.0), (50.0, 60.0), (70.0, 80.0)]
    assert (rows["N", 1].pts[0].x, rows["A", 3].attrs[0].minor, rows["L", 2].left_area) == (5.5, 101, 4)


def test_line_graph_headers_and_writer(spark, tmp_path):
    head = {"name": "BOZEMAN", "postal": "MT WY", "zone": 12, "datum": 1, "theme": "HYDROGRAPHY"}
    head |= {f"{k}_{c}": v for c, at in {"sw": (45.75, -111.25, 480554.09, 5066083.19), "nw": (46.0, -111.25, 480640.5, 5093860.0), "ne": (46.0, -111.0, 500000.0, 5093828.25), "se": (45.75, -111.0, 500000.0, 5066051.5)}.items() for k, v in zip(("lat", "lon", "x", "y"), at, strict=True)}
    lines = [(1, 1, 2, 1, 2, [(1.0, 2.0), (3.0, 4.0)], [(50, 412)]), (2, 2, 1, 1, 2, [(3.0, 4.0), (1.0, 2.0)], []), (3, 1, 1, 2, 2, [(1.0, 2.0), (5.0, 5.0), (1.0, 2.0)], [])]
    good = graph.encode("x", [(1, 1.0, 2.0, []), (2, 3.0, 4.0, [(1, 2)])], [(2, 7.0, 8.0, [], [1, 2, 0, 3])], lines, head)
    (tmp_path / "good.opt").write_bytes(good)
    (tmp_path / "lines.opt").write_text("\n".join(good.decode()[k : k + 80].rstrip() for k in range(0, len(good), 80)) + "\n")
    (tmp_path / "zone.opt").write_bytes(graph.encode("Z", [], [], [], head | {"zone": 61}))
    (tmp_path / "plane.opt").write_bytes(graph.encode("P", [], [], [], head | {"plane_ref": 3, "zone": 9999}))
    (tmp_path / "short.opt").write_bytes(b"S".ljust(80))
    assert good[80:].startswith(b"BOZEMAN, MT WY  ") and len(good) % 80 == 0
    text = good.decode()
    recs = [text[k : k + 80] for k in range(15 * 80, len(text), 80)]
    assert recs[0][36:42].strip() == "4" and recs[1].split() == ["1", "-2", "3", "-3"]
    area = next(k for k, r in enumerate(recs) if r[0] == "A")
    assert (recs[area][36:42], recs[area][60:66]) == ("     4", "     1") and recs[area + 1].split() == ["1", "2", "0", "3"]
    heads = graph.read_headers(spark, str(tmp_path / "*.opt"))
    got = {r.file.rpartition("/")[2]: r for r in heads.collect()}
    for name in ("good.opt", "lines.opt"):
        r = got[name]
        assert {k: r[k] for k in head} == head and (r.plane_ref, r.n_nodes, r.n_areas, r.n_lines, r.reject) == (1, 2, 1, 3, None)
        assert r.linefeeds == (name == "lines.opt")
    assert got["zone.opt"].reject == "no zone 61" and "not UTM" in got["plane.opt"].reject and got["short.opt"].reject.startswith("fewer")
    line = sinks.graph_line(F.lit("a.opt"), F.col("name"), F.col("theme"), tuple(F.col(c) for c in ("lat_se", "lon_se", "lat_nw", "lon_nw")), F.col("linefeeds"), F.col("postal"))
    assert heads.filter("linefeeds and reject is null").select(line.alias("l")).first().l == "a.opt\tBOZEMAN\tMT WY\tHYDROGRAPHY\t45.75:-111:46:-111.25\tlinefeeds=yes"
    assert graph.read(spark, str(tmp_path / "lines.opt")).drop("file").collect() == graph.read(spark, str(tmp_path / "good.opt")).drop("file").collect()
    for wide in ([(100_000, 0.0, 0.0, [])], [(1, 1e10, 0.0, [])], [(1, 0.0, 0.0, [(1_000_000, 1)])]):
        with pytest.raises(ValueError, match="does not fit"):
            graph.encode("W", wide, [], [])
    rows = graph.read(spark, str(tmp_path / "good.opt"))
    file = rows.first().file
    rings = spark.createDataFrame([(file, 2, [1, 2, 0, 3])], "file string, area long, ring array<long>")
    again = graph.encode_graphs(rows, heads.filter(F.col("file") == file), rings).collect()
    assert len(again) == 1 and bytes(again[0].content) == good
    empty = graph.encode_graphs(rows.filter("false"), heads.filter(F.col("file") == file), rings).first()
    assert graph.parse_header(bytes(empty.content))["n_lines"] == 0 and len(empty.content) == 15 * 80


def test_rules_dispatch_and_sinks(spark, tmp_path):
    (tmp_path / "rules").write_text("# c\nN 1 2\nL  50 -1 water\n A 90 1\nA\t90 100 towns\nL 170 203")
    assert {tuple(r) for r in graph.read_rules(spark, str(tmp_path / "rules")).collect()} == {("L", 50, -1), ("A", 90, 100), ("L", 170, 203)}
    df = spark.createDataFrame([("x/1107CEL0.DDF",), ("1107LE01.ddf.gz",), ("w.HDR",), ("a.dem",)], "p string")
    assert [r.t.fmt for r in df.select(dispatch.format_of(F.col("p")).alias("t")).collect()] == ["sdts_dem", "sdts_dlg", "gtopo30", "classic"]
    assert df.select(dispatch.companion(F.col("p"), "IDEN").alias("c")).first().c == "x/1107IDEN.DDF"
    sinks.rasterfile(str(tmp_path / "o.sun"), 3, 2, [(1, 2, 3)], spark.createDataFrame([(0, 0, 5), (2, 1, 6)], "x int, y int, color int"))
    raw = (tmp_path / "o.sun").read_bytes()
    assert len(raw) == 32 + 768 + 8 and raw[800] == 5 and raw[806] == 6 and raw[:4].hex() == "59a66a95"
    with pytest.raises(FileExistsError):
        sinks.rasterfile(str(tmp_path / "o.sun"), 1, 1, [], spark.createDataFrame([], "x int, y int, color int"))
    sinks.grey_map(str(tmp_path / "o.pgm"), spark.createDataFrame([(0, 0, 7), (0, 1, 65535)], "i int, j int, height int"))
    assert (tmp_path / "o.pgm").read_text().split()[:4] == ["P2", "2", "1", "65535"]


def test_stream_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1|A|Locale|MT|30|c|063|x|y|46.5|-114.5|||\n2|B|Locale|MT|30|c|063|x|y|50|-114.5|||\n")
    q = places.search_stream(spark, str(tmp_path / "in"), (46, -115, 47, -114)).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r.raw[0] for r in spark.table("found").collect()] == ["1"]
