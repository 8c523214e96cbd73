"""Nodes, areas and lines: selection by attribute rules, topology lists, clipping, drawing, filling, layering."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY_ID = 10000


def _kind(rules, kind):
    return [(a, b) for k, a, b in rules if k == kind]


def _fits(major: int, minor: int):
    return lambda a: (F.lit(major < 0) | (a["major"] == major)) & (F.lit(minor < 0) | (a["minor"] == minor))


def matches_rules(attrs: Column, rules, kind: str = "L") -> Column:
    """Any attribute of ``array<struct<major, minor>>`` fits any rule (kind, major, minor); negative rule values fit all."""
    fit = F.lit(False)
    for major, minor in _kind(rules, kind):
        fit = fit | F.exists(attrs, _fits(major, minor))
    return F.coalesce(fit, F.lit(False))


def draws_line(attrs: Column, line_id: Column, theme: Column, left: Column, right: Column, rules) -> Column:
    """Lines to draw: without rules all but neatlines; else those whose attributes, theme (when bare) or id fit a rule."""
    neat = F.coalesce((left == 1) | (right == 1), F.lit(False))
    if not rules:
        return ~neat
    by_id = F.lit(False)
    bare = F.lit(False)
    for major, minor in _kind(rules, "L"):
        if major == BY_ID:
            by_id = by_id | (line_id == minor)
        elif minor < 0:
            bare = bare | (F.lit(major < 0) | (theme == major))
    return by_id | (~neat & F.when(F.size(attrs) > 0, matches_rules(attrs, [r for r in rules if r[1] != BY_ID])).otherwise(bare))


def unique_attributes(attrs: Column, exempt: int = 177) -> Column:
    """The last of equal attributes stays; those of major ``exempt`` all stay."""
    n = F.size(attrs)
    marks = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(attrs, k).alias("v"), F.exists(F.slice(attrs, k + 1, n), lambda z: z == F.element_at(attrs, k)).alias("later")))
    kept = F.transform(F.filter(marks, lambda r: ~r["later"] | (r["v"]["major"] == exempt)), lambda r: r["v"])
    return F.when(n > 0, kept).otherwise(attrs)


def node_lines(lines: DataFrame) -> DataFrame:
    """``(node, lines)``: ids of lines that start there, negative of those that end there, by id."""
    ends = lines.select(F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.col("id").alias("s")), F.struct(F.col("end_node").alias("node"), (-F.col("id")).alias("s")))).alias("t"))
    return ends.select("t.*").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.abs("s").alias("a"), (-F.col("s")).alias("b")))), lambda x: -x["b"]).alias("lines"))


def area_lines(lines: DataFrame) -> DataFrame:
    """``(area, lines)``: ids of lines with the area on exactly one side, negative where it is on the left."""
    some = lines.filter("left_area <> right_area")
    sides = some.select(F.explode(F.array(F.struct(F.col("right_area").alias("area"), F.col("id").alias("s")), F.struct(F.col("left_area").alias("area"), (-F.col("id")).alias("s")))).alias("t"))
    return sides.select("t.*").groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.abs("s").alias("a"), (-F.col("s")).alias("b")))), lambda x: -x["b"]).alias("lines"))


def segments(points: DataFrame) -> DataFrame:
    """``(line, pos, x, y)`` -> consecutive pairs ``(line, pos, x1, y1, x2, y2)``."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("line").orderBy("pos")
    return points.select("line", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null")


def clip(segs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The part of each segment inside the box (edges included); segments wholly outside are dropped.

    A segment with an end outside is cut where it meets the edges, tried in the order west, east, south, north; with both
    ends outside it has to meet exactly two.
    """
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    inside = lambda x, y: x.between(west, east) & y.between(south, north)
    between = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    hits = []
    for edge in (west, east):
        y = c("y1") + dy * F.try_divide(F.lit(float(edge)) - c("x1"), dx)
        hits.append(F.when((dx != 0) & between(F.lit(float(edge)), c("x1"), c("x2")) & y.between(south, north), F.struct(F.lit(float(edge)).alias("x"), y.alias("y"))))
    for edge in (south, north):
        x = c("x1") + dx * F.try_divide(F.lit(float(edge)) - c("y1"), dy)
        hits.append(F.when((dy != 0) & between(F.lit(float(edge)), c("y1"), c("y2")) & x.between(west, east), F.struct(x.alias("x"), F.lit(float(edge)).alias("y"))))
    kept = segs.withColumns({"h": F.filter(F.array(*hits), lambda t: t.isNotNull()), "in1": inside(c("x1"), c("y1")), "in2": inside(c("x2"), c("y2"))})
    kept = kept.filter((c("in1") & c("in2")) | ((c("in1") != c("in2")) & (F.size("h") >= 1)) | (~c("in1") & ~c("in2") & (F.size("h") == 2)))
    first, last = F.get("h", F.lit(0)), F.when(c("in1"), F.get("h", F.lit(0))).otherwise(F.get("h", F.lit(1)))
    rest = [k for k in segs.columns if k not in ("x1", "y1", "x2", "y2")]
    return kept.select(*rest, F.when(c("in1"), c("x1")).otherwise(first["x"]).alias("x1"), F.when(c("in1"), c("y1")).otherwise(first["y"]).alias("y1"), F.when(c("in2"), c("x2")).otherwise(last["x"]).alias("x2"), F.when(c("in2"), c("y2")).otherwise(last["y"]).alias("y2"))


def draw(segs: DataFrame) -> DataFrame:
    """Pixels of integer segments: both ends, and one for each step of the longer axis between them.

    The longer axis moves by one a step, so a segment's pixels differ and nothing is shuffled.
    """
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    n = F.greatest(F.abs(dx), F.abs(dy))
    k = segs.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    at = lambda a, d: F.when(c("k") == c("n"), c(a) + d).otherwise(F.round(c(a) + c("k") * F.try_divide(d.cast("double"), c("n")))).cast("int")
    rest = [x for x in segs.columns if x not in ("x1", "y1", "x2", "y2")]
    return k.select(*rest, F.coalesce(at("x1", dx), c("x1")).alias("x"), F.coalesce(at("y1", dy), c("y1")).alias("y"))


def composite(pixels: DataFrame) -> DataFrame:
    """``(x, y, z, color)`` -> the colour of the last layer at each pixel."""
    return pixels.groupBy("x", "y").agg(F.max_by("color", "z").alias("color"))


#: Side of the square tiles in which ``paint`` draws, and how many pixels it draws at a time.
TILE, AT_ONCE = 2048, 1 << 19


def _by_tile(segs: DataFrame) -> DataFrame:
    """``(tile, z, a, b, color)``: each segment once for each tile that its pixels lie in; a and b hold an end's x and y."""
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    wide = F.abs(dx) >= F.abs(dy)
    pick = lambda k: (F.when(wide, c(f"x{k}")).otherwise(c(f"y{k}")), F.when(wide, c(f"y{k}")).otherwise(c(f"x{k}")))
    (u1, v1), (u2, v2) = pick(1), pick(2)
    ints = segs.select(*(c(k).cast("long").alias(k) for k in ("x1", "y1", "x2", "y2")), "z", "color").na.drop(subset=["x1", "y1", "x2", "y2"])
    ends = ints.select("*", wide.alias("wide"), u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))
    tile = lambda v: F.floor(v / TILE)
    along = ends.select("*", F.explode(F.sequence(tile(F.least("u1", "u2")), tile(F.greatest("u1", "u2")))).alias("tu"))
    low, high = F.greatest(c("tu") * TILE, F.least("u1", "u2")), F.least(c("tu") * TILE + TILE - 1, F.greatest("u1", "u2"))
    at = lambda u: F.coalesce(F.round(c("v1") + F.abs(u - c("u1")) * F.try_divide((c("v2") - c("v1")).cast("double"), F.abs(c("u2") - c("u1")))), c("v1").cast("double"))
    across = F.sequence(tile(F.least(at(low), at(high))), tile(F.greatest(at(low), at(high))))
    met = along.select("*", F.explode(across).alias("tv"))
    pair = lambda x, y: F.shiftleft(x, 32) + F.pmod(y, F.lit(1 << 32))
    tx, ty = (F.when(c("wide"), c(a)).otherwise(c(b)) for a, b in (("tu", "tv"), ("tv", "tu")))
    return met.select(pair(tx, ty).alias("tile"), "z", pair(c("x1"), c("y1")).alias("a"), pair(c("x2"), c("y2")).alias("b"), F.when(c("z").isNotNull(), c("color")).cast("int").alias("color"))


def _unpair(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v >> 32, (v << 32) >> 32


class _Tile:
    """A tile that is painted from its last segment to its first: a pixel keeps what it got first."""

    def __init__(self, key: int):
        (self.x,), (self.y,) = (v * TILE for v in _unpair(np.array([key])))
        self.filled, self.color = np.zeros(TILE * TILE, bool), np.zeros(TILE * TILE, np.int64)
        self.drawn, self.free = 0, (0, TILE - 1, 0, TILE - 1)

    def look(self) -> None:
        """The box of what is still free, or nothing, so that segments which cannot be seen cost little."""
        self.drawn, bare = 0, ~self.filled.reshape(TILE, TILE)
        xs, ys = np.flatnonzero(bare.any(axis=0)), np.flatnonzero(bare.any(axis=1))
        self.free = (xs[0], xs[-1], ys[0], ys[-1]) if len(xs) else None

    def paint(self, a: np.ndarray, b: np.ndarray, color: np.ndarray) -> None:
        if self.free is None:
            return
        (x1, y1), (x2, y2) = _unpair(a), _unpair(b)
        x1, x2, y1, y2 = x1 - self.x, x2 - self.x, y1 - self.y, y2 - self.y
        wide = np.abs(x2 - x1) >= np.abs(y2 - y1)
        u1, v1, u2, v2 = (np.where(wide, p, q) for p, q in ((x1, y1), (y1, x1), (x2, y2), (y2, x2)))
        n, way = np.abs(u2 - u1), np.sign(u2 - u1)
        slope = (v2 - v1) / np.maximum(n, 1)
        x_low, x_high, y_low, y_high = self.free
        u_low, u_high = np.where(wide, x_low, y_low), np.where(wide, x_high, y_high)
        first = np.maximum(0, np.where(way >= 0, u_low - u1, u1 - u_high))
        last = np.minimum(n, np.where(way >= 0, u_high - u1, u1 - u_low))
        last = np.where((way == 0) & ((u1 < u_low) | (u1 > u_high)), -1, last)
        size = np.maximum(0, last - first + 1)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            self._some(*(t[lo:hi] for t in (u1, v1, way, slope, wide, first, size, color)))
            lo = hi

    def _some(self, u1, v1, way, slope, wide, first, size, color) -> None:
        total = int(size.sum())
        if not total or self.free is None:
            return
        seg = np.repeat(np.arange(len(size)), size)
        k = np.arange(total) + (first - (np.cumsum(size) - size))[seg]
        # The whole coordinate is added ahead of rounding, as in ``draw``, and rounding goes away from zero there too.
        base = np.where(wide, self.y, self.x)
        v = (v1 + base)[seg] + k * slope[seg]
        whole = np.floor(np.abs(v))
        v = (np.copysign(whole + (np.abs(v) - whole >= 0.5), v)).astype(np.int64) - base[seg]
        u = u1[seg] + way[seg] * k
        inside = (v >= 0) & (v < TILE)
        at = np.where(wide[seg], v * TILE + u, u * TILE + v)[inside]
        new = ~self.filled[at]
        at, seg = at[new][::-1], seg[inside][new][::-1]
        self.color[at] = color[seg]
        self.filled[at] = True
        self.drawn += total
        if self.drawn >= 2 * TILE * TILE:
            self.look()

    def rows(self):
        at = np.flatnonzero(self.filled)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            color = self.color[some]
            yield pa.RecordBatch.from_arrays([pa.array(self.x + some % TILE, pa.int32()), pa.array(self.y + some // TILE, pa.int32()), pa.array(color, pa.int64(), mask=color == NO_COLOR).cast(pa.int32())], ["x", "y", "color"])


NO_COLOR = -(1 << 40)


def paint(segs: DataFrame) -> DataFrame:
    """Integer segments ``(x1, y1, x2, y2, z, color)`` -> ``(x, y, color)``, the rows of ``composite`` of ``draw``; a
    segment that lacks a coordinate has no place and is left out.

    Segments, not pixels, are dealt out: each once for each tile it meets, and a tile's are drawn from the greatest z down into
    one array of the tile's size, so that memory does not grow with the input and no pixel is shuffled.
    """
    dealt = _by_tile(segs).repartition("tile").sortWithinPartitions("tile", F.desc("z"))

    def run(batches):
        now, key = None, None
        for batch in batches:
            keys, a, b = (batch.column(c).to_numpy() for c in ("tile", "a", "b"))
            color = batch.column("color").cast(pa.int64()).fill_null(NO_COLOR).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if now is None or keys[lo] != key:
                    if now is not None:
                        yield from now.rows()
                    now, key = _Tile(keys[lo]), keys[lo]
                now.paint(a[lo:hi], b[lo:hi], color[lo:hi])
        if now is not None:
            yield from now.rows()

    return dealt.select("tile", "a", "b", "color").mapInArrow(run, "x int, y int, color int")


def flood_fill(pixels: DataFrame, seeds: DataFrame, color: int) -> DataFrame:
    """``pixels(box, x, y, color)`` and ``seeds(box, x, y)`` -> ``(box, x, y)`` to paint: what is joined to a seed of the box
    by its four sides without crossing ``color``. A box is one group: its size is that of an image, not of the data."""

    def run(key, px: pd.DataFrame, sd: pd.DataFrame) -> pd.DataFrame:
        free = {(x, y) for x, y, c in zip(px["x"], px["y"], px["color"], strict=True) if c != color}
        queue = deque(p for p in zip(sd["x"], sd["y"], strict=True) if p in free)
        seen = set(queue)
        while queue:
            x, y = queue.popleft()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in free and p not in seen:
                    seen.add(p)
                    queue.append(p)
        return pd.DataFrame([(key[0], *p) for p in seen], columns=["box", "x", "y"])

    return pixels.groupBy("box").cogroup(seeds.groupBy("box")).applyInPandas(run, "box long, x int, y int")


def walk_rings(ids, entries, exits, tops) -> list[int]:
    """Signed ids in the order of a walk that starts at the line of greatest top; 0 where an island begins.

    The next line is the first of the rest that enters where the last one left; it changes places with the one that
    stands there. Where none does, or a line is a loop by itself, the line that stands next moves to the end of the list.
    """
    order = list(range(len(ids)))
    if not order:
        return []
    lead = max(order, key=lambda k: (tops[k], -k))
    order[0], order[lead] = lead, 0
    place = {k: at for at, k in enumerate(order)}
    into: dict = {}
    for k, node in enumerate(entries):
        into.setdefault(node, set()).add(k)
    out, j = [], 0
    while j < len(order):
        cur = order[j]
        into[entries[cur]].discard(cur)
        out.append(int(ids[cur]))
        after = None
        if entries[cur] != exits[cur]:
            after = min(into.get(exits[cur], ()), key=place.__getitem__, default=None)
            if after is not None:
                at, other = place[after], order[j + 1]
                order[j + 1], order[at] = after, other
                place[after], place[other] = j + 1, at
        if after is None and j < len(order) - 1:
            out.append(0)
            moved = order[j + 1]
            order.append(moved)
            place[moved] = len(order) - 1
            order[j + 1] = -1
            j += 1
        j += 1
    return out


def assemble_rings(lines: DataFrame) -> DataFrame:
    """``(area, id, left_area, right_area, start_node, end_node, top)`` -> ``(area, ring)``: signed line ids that follow
    each other as in ``walk_rings``; negative where the area is on the left. Lines with one area on both sides bound none.

    Areas travel many to a batch; an area's own lines are one walk and have to be together.
    """
    some = lines.filter("left_area <> right_area and (left_area = area or right_area = area)")
    right = F.col("right_area") == F.col("area")
    each = some.select("area", F.struct(F.col("id").cast("long").alias("id"), F.when(right, F.col("id")).otherwise(-F.col("id")).cast("long").alias("s"), F.when(right, F.col("start_node")).otherwise(F.col("end_node")).cast("long").alias("entry"), F.when(right, F.col("end_node")).otherwise(F.col("start_node")).cast("long").alias("exit"), F.col("top").cast("double").alias("top")).alias("l"))
    packed = each.groupBy("area").agg(F.array_sort(F.collect_list("l")).alias("ls")).select(F.col("area").cast("long").alias("area"), "ls")

    def run(batches):
        for b in batches:
            ls = b.column("ls")
            flat, ends = ls.flatten(), np.cumsum([0, *(len(x) for x in ls)])
            cols = [flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("s", "entry", "exit", "top")]
            rings = [walk_rings(*(c[lo:hi] for c in cols)) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("area"), pa.array(rings, pa.list_(pa.int64()))], ["area", "ring"])

    return packed.mapInArrow(run, "area long, ring array<long>")


def islands(rings: DataFrame) -> DataFrame:
    """``(area, islands)``: how many rings follow the first."""
    return rings.select("area", F.size(F.filter("ring", lambda k: k == 0)).alias("islands"))


def northmost(lines: DataFrame) -> DataFrame:
    """``(area, id)``: of the lines ``(id, left_area, right_area, top)`` on either side of an area the first that reaches furthest north."""
    sides = lines.select(F.explode(F.array("left_area", "right_area")).alias("area"), "id", "top")
    return sides.groupBy("area").agg(F.max_by("id", F.struct("top", -F.col("id"))).alias("id"))


def renumbered(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """``nodes(file, id)`` and ``entities(file, ne)`` -> ``(file, ne, new_id)``: a file's gaps among its node ids from 1 on
    are taken up, in order, by its entity nodes, and what is left of them follows the last id."""
    from pyspark.sql.window import Window

    counted = nodes.groupBy("file").agg(F.max("id").alias("most")).join(entities.groupBy("file").agg(F.count("*").alias("more")), "file", "full")
    every = counted.select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("most", F.lit(0)) + F.coalesce("more", F.lit(0)))).alias("id"))
    w = lambda c: Window.partitionBy("file").orderBy(c)
    gaps = every.join(nodes.select("file", "id"), ["file", "id"], "left_anti").withColumn("k", F.row_number().over(w("id")))
    return entities.withColumn("k", F.row_number().over(w("ne"))).join(gaps, ["file", "k"]).select("file", "ne", F.col("id").alias("new_id"))


def repointed(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Lines ``(file, ..., ne)`` of entity nodes begin and end at the nodes' new numbers; lines without ``ne`` stay."""
    rest = [c for c in lines.columns if c not in ("ne", "start_node", "end_node")]
    met = lines.join(numbers, ["file", "ne"], "left")
    return met.select(*rest, *(F.coalesce("new_id", F.col(c).cast("long")).alias(c) for c in ("start_node", "end_node")))


def with_attributes(features: DataFrame, attributes: DataFrame) -> DataFrame:
    """``features(file, id, seq, module, rcid)`` and ``attributes(file, module, rcid, k, major, minor)`` -> ``(file, id, attrs)``:
    what a feature's links lead to, in the order of links and records; a link to nothing says nothing."""
    met = features.join(attributes, ["file", "module", "rcid"])
    return met.groupBy("file", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "major", "minor"))), lambda t: F.struct(t["major"], t["minor"])).alias("attrs"))


def polygon_attributes(areas: DataFrame, polygons: DataFrame, attributes: DataFrame) -> DataFrame:
    """``areas(file, id, poly)`` by ``polygons(file, poly, seq, module, rcid)`` to the attributes of their polygons."""
    return with_attributes(areas.join(polygons, ["file", "poly"]).select("file", "id", "seq", "module", "rcid"), attributes)


def overlaps(sw_lat: Column, sw_lon: Column, ne_lat: Column, ne_lon: Column, box: tuple[float, float, float, float], touching: bool) -> Column:
    """Whether a tile meets ``box`` (south, west, north, east); ``touching``: an edge in common is enough (line graphs),
    else it is not (elevation models)."""
    south, west, north, east = box
    if touching:
        return ~((sw_lat > north) | (ne_lat < south) | (sw_lon > east) | (ne_lon < west))
    return ~((sw_lat >= north) | (ne_lat <= south) | (sw_lon >= east) | (ne_lon <= west))


def areas_to_fill(areas: DataFrame, rules) -> DataFrame:
    """Areas ``(id, attrs, ...)`` that a rule of kind A selects by an attribute or, as major BY_ID, by id; without such rules
    none, and without attributes never."""
    by_id = F.lit(False)
    for major, minor in _kind(rules, "A"):
        by_id = by_id | (F.lit(major == BY_ID) & (F.col("id") == minor))
    return areas.filter((F.size("attrs") > 0) & (matches_rules(F.col("attrs"), [r for r in rules if r[1] != BY_ID], "A") | by_id))


def fill_areas(pixels: DataFrame, areas: DataFrame, rules, color: int) -> DataFrame:
    """``pixels(box, x, y, color)`` of a graph's box and its ``areas(box, id, x, y, attrs)`` in pixels -> the pixels to paint."""
    return flood_fill(pixels, areas_to_fill(areas, rules).select("box", "x", "y"), color)
