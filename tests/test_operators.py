import random

import numpy as np

from gridloom.operators import grid, vector


def cells(spark, rows):
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "i int, j int, elev int")


def as_grid(df, n, m):
    out = [[None] * m for _ in range(n)]
    for r in df.collect():
        out[r.i][r.j] = r.elev
    return out


def some_grid(n=9, m=11, seed=1, holes=0.3):
    rng = random.Random(seed)
    return [[None if rng.random() < holes else rng.randint(-20, 900) for _ in range(m)] for _ in range(n)]


def test_void_fill_follows_row_order(spark):
    g = some_grid()
    n, m = len(g), len(g[0])
    want = [r[:] for r in g]
    for i in range(n):
        row = g[i][:]
        for j in range(m):
            if row[j] is not None:
                continue
            at = lambda di, dj, row=row, i=i, j=j: None if not (0 <= i + di < n and 0 <= j + dj < m) else row[j + dj] if di == 0 else g[i + di][j + dj]
            pairs = [(at(*a), at(*b)) for a, b in grid.BRIDGES]
            vs = [v for p in pairs if None not in p for v in p]
            if vs:
                row[j] = int(sum(vs) / len(vs))
        want[i] = row
    assert as_grid(grid.fill_voids(cells(spark, g)), n, m) == want


def test_smooth_against_loops(spark):
    g = some_grid(seed=2)
    n, m = len(g), len(g[0])
    w = grid.kernel(2, 2.0)
    got = as_grid(grid.smooth(cells(spark, g), w), n, m)
    for i in range(n):
        for j in range(m):
            vs = [(k, g[i - a][j - b]) for a, b, k in w if 0 <= i - a < n and 0 <= j - b < m and g[i - a][j - b] is not None]
            den = sum(k for k, _ in vs)
            want = None if not den else int(np.floor(abs(x := sum(k * v for k, v in vs) / den) + 0.5) * (1 if x >= 0 else -1))
            assert got[i][j] == want


def test_mosaic_extremes_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, None), (2, 0, 1, 7), (1, 0, 1, 9), (3, 1, 1, 7)], "seq int, i int, j int, elev int")
    m = grid.mosaic(df)
    assert {(r.i, r.j): r.elev for r in m.collect()} == {(0, 0): 5, (0, 1): 7, (1, 1): 7}
    assert tuple(grid.extremes(m).first()) == (5, 0, 0, 7, 0, 1)
    assert grid.fill_voids(cells(spark, [])).count() == 0


def test_unique_attributes(spark):
    one = "named_struct('major', {}, 'minor', {})"
    df = spark.sql(f"select array({', '.join(one.format(a, b) for a, b in [(50, 610), (50, 412), (50, 202), (50, 610), (177, 1), (177, 1)])}) a union all select cast(array() as array<struct<major:int,minor:int>>)")
    got = [[(x.major, x.minor) for x in r.u] for r in df.select(vector.unique_attributes(df.a).alias("u")).collect()]
    assert got == [[(50, 412), (50, 202), (50, 610), (177, 1), (177, 1)], []]


def test_clip_and_draw(spark):
    segs = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, 1.0, 1.0, 2.0, 2.0), (3, -5.0, -5.0, -1.0, 20.0), (4, 5.0, -3.0, 5.0, 4.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.x1, r.y1, r.x2, r.y2) for r in vector.clip(segs, 0, 0, 10, 10).collect()}
    assert got == {1: (0.0, 5.0, 10.0, 5.0), 2: (1.0, 1.0, 2.0, 2.0), 4: (5.0, 0.0, 5.0, 4.0)}
    px = vector.draw(spark.createDataFrame([(0, 0, 4, 2), (3, 3, 3, 3)], "x1 int, y1 int, x2 int, y2 int"))
    assert {(r.x, r.y) for r in px.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (3, 3)}


def test_paint_is_the_composite_of_draw_without_a_shuffle_of_pixels(spark, monkeypatch):
    rng = random.Random(7)
    far = lambda: rng.randint(-5000, 5000)
    rows = [(far(), far(), far(), far(), z, z % 5) for z in range(60)] + [(-1, -1, 2047, -1, 60, 7), (2048, 0, 2048, 4096, 61, 8), (3, 3, 3, 3, 62, 9), (None, 1, 2, 3, 63, 1), (-2050, 7, -2040, 12, None, 4), (9, 9, 12, 9, 64, None)]
    segs = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, z long, color int")
    both = lambda df: sorted((r.x, r.y, r.color is None, r.color or 0) for r in df.collect())
    want = both(vector.composite(vector.draw(segs.na.drop(subset=["x1"]))))
    done = vector.paint(segs)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange ") == 1
    assert both(done) == want
    # Small tiles, looked at often: what is hidden is left out, nothing else.
    monkeypatch.setattr(vector, "TILE", 16)
    monkeypatch.setattr(vector, "AT_ONCE", 40)
    crowd = [tuple(rng.randint(-40, 40) for _ in range(4)) + (z, z % 11) for z in range(3000)]
    tiles = {}
    for x1, y1, x2, y2, z, color in sorted(crowd, key=lambda r: -r[4]):
        for tx in range(-3, 3):
            for ty in range(-3, 3):
                t = tiles.setdefault((tx, ty), vector._Tile((tx << 32) + ty % (1 << 32)))
                pair = lambda x, y: np.array([(x << 32) + y % (1 << 32)])
                t.paint(pair(x1, y1), pair(x2, y2), np.array([color]))
    got = sorted(r for t in tiles.values() for b in t.rows() for r in zip(*(b.column(c).to_pylist() for c in ("x", "y", "color")), strict=True))
    assert any(t.free is None for t in tiles.values())
    assert got == sorted((r.x, r.y, r.color) for r in vector.composite(vector.draw(spark.createDataFrame(crowd, "x1 int, y1 int, x2 int, y2 int, z int, color int"))).collect())


def test_fill_stops_at_walls(spark):
    rows = ["..#..", "..#..", "..#.."]
    px = spark.createDataFrame([(1, x, y, 9 if c == "#" else 0) for y, r in enumerate(rows) for x, c in enumerate(r)], "box long, x int, y int, color int")
    got = vector.flood_fill(px, spark.createDataFrame([(1, 0, 1)], "box long, x int, y int"), 9)
    assert {(r.x, r.y) for r in got.collect()} == {(x, y) for x in (0, 1) for y in (0, 1, 2)}


def test_rings(spark):
    rows = [(7, 1, 9, 7, 1, 2, 1.0), (7, 2, 7, 9, 3, 2, 5.0), (7, 3, 9, 7, 3, 1, 2.0), (7, 4, 9, 7, 8, 8, 0.0)]
    got = vector.assemble_rings(spark.createDataFrame(rows, "area long, id long, left_area long, right_area long, start_node long, end_node long, top double")).first()
    assert got.ring == [-2, 3, 1, 0, 4]
