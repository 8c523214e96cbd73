"""Classic elevation models of 1024-byte records: reading, writing, and undoing fixed blocks; 30-arc-second tiles."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iso8211 import unpack

RECORD = 1024
FIRST_BLOCK, LATER_BLOCK = 146, 170
VOIDS = (-32767, 32767)
FOOT = 0.3048
HEADER = "file string, title string, level int, plane_ref int, zone int, plane_units int, elev_units int, sw_x double, sw_y double, nw_x double, nw_y double, ne_x double, ne_y double, se_x double, se_y double, min_elev double, max_elev double, angle double, accuracy int, x_res double, y_res double, z_res double, rows int, cols int"
PROFILES = "file string, col int, x_gp double, y_gp double, samples array<int>"
CELLS = "file string, i int, j int, elev int"


def _number(raw: bytes) -> float:
    s = raw.decode("ascii", "replace").replace("D", "E").replace("d", "e").strip()
    try:
        return float(s)
    except ValueError:
        return 0.0


def plain(data: bytes) -> bytes:
    """Without the line ends that some files put after each record."""
    data = unpack(data)
    if b"\n" not in data[: RECORD + 2]:
        return data
    return b"".join(line.ljust(RECORD)[:RECORD] for line in data.replace(b"\r", b"").split(b"\n") if line)


def header(data: bytes) -> tuple:
    a = data[:RECORD].ljust(RECORD)
    n = lambda lo, hi: int(_number(a[lo:hi]))
    corners = [_number(a[546 + 24 * k : 570 + 24 * k]) for k in range(8)]
    res = [_number(a[lo : lo + 12]) for lo in (816, 828, 840)]
    return (a[:80].decode("ascii", "replace").strip(), n(144, 150), n(156, 162), n(162, 168), n(528, 534), n(534, 540), *corners, _number(a[738:762]), _number(a[762:786]), _number(a[786:810]), n(810, 816), float(round(res[0])), float(round(res[1])), res[2], n(852, 858), n(858, 864))


def profiles(data: bytes):
    """Yields (column, x, y, samples) south to north, each profile starting on a record."""
    at = RECORD
    cols = header(data)[-1]
    for col in range(cols):
        b = data[at : at + RECORD]
        if len(b) < 144:
            return
        count, x, y = int(_number(b[12:18])), _number(b[24:48]), _number(b[48:72])
        samples, left, lo = [], count, 144
        while left > 0:
            take = min(left, (RECORD - lo) // 6 if lo == 144 else LATER_BLOCK, FIRST_BLOCK if lo == 144 else LATER_BLOCK)
            samples += [int(_number(b[lo + 6 * k : lo + 6 * k + 6])) for k in range(take)]
            left -= take
            if left > 0:
                at += RECORD
                b, lo = data[at : at + RECORD], 0
        at += RECORD
        yield col, x, y, samples


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per file; selections on it decide which files' samples are read at all."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(p, *header(plain(c))) for p, c in zip(b["path"], b["content"], strict=True)], columns=[x.split()[0] for x in HEADER.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, HEADER)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *row) for row in profiles(plain(c))], columns=["file", "col", "x_gp", "y_gp", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PROFILES)


def to_cells(profile: DataFrame, head: DataFrame) -> DataFrame:
    """Ragged profiles into a rectangle, row 0 in the north: feet become metres, +-32767 no data.

    The rectangle is that of the profiles' own ends, column by x and row by y over the header's spacing.
    """
    p = profile.join(head.select("file", "plane_ref", "elev_units", "x_res", "y_res"), "file").filter(F.size("samples") > 0)
    span = p.groupBy("file").agg(F.min("x_gp").alias("x0"), F.max(F.col("y_gp") + (F.size("samples") - 1) * F.col("y_res")).alias("y1"))
    each = p.join(span, "file").select("file", "plane_ref", "elev_units", "x_gp", "y_gp", "x_res", "y_res", "x0", "y1", F.posexplode("samples").alias("k", "v"))
    metres = F.when(F.col("elev_units") == 1, F.round(F.col("v") * FOOT).cast("int")).otherwise(F.col("v"))
    return each.select("file", F.round((F.col("y1") - F.col("y_gp")) / F.col("y_res") - F.col("k")).cast("int").alias("i"), F.round((F.col("x_gp") - F.col("x0")) / F.col("x_res")).cast("int").alias("j"), F.when(~F.col("v").isin(*VOIDS), metres).alias("elev"))


def encode(title: str, zone: int, x0: float, y0: float, res: float, grid: list[list[int | None]], void: int = -32767) -> bytes:
    """A classic model from rows north first; profiles go west to east, samples south to north."""
    rows, cols = len(grid), len(grid[0])
    real = [v for r in grid for v in r if v is not None] or [0]
    d = lambda v: f"{v:24.15E}".replace("E", "D")
    x1, y1 = x0 + res * (cols - 1), y0 + res * (rows - 1)
    a = title.ljust(144)[:144] + f"{1:6d}{1:6d}{1:6d}{zone:6d}" + " " * 360 + f"{2:6d}{2:6d}{4:6d}"
    a += "".join(map(d, (x0, y0, x0, y1, x1, y1, x1, y0, min(real), max(real), 0.0))) + f"{0:6d}" + "".join(f"{v:12.6E}" for v in (res, res, 1.0)) + f"{1:6d}{cols:6d}"
    out = a.ljust(RECORD).encode()
    for j in range(cols):
        col = [grid[rows - 1 - k][j] for k in range(rows)]
        have = [v for v in col if v is not None]
        b = f"{1:6d}{j + 1:6d}{rows:6d}{1:6d}" + d(x0 + res * j) + d(y0) + d(0.0) + d(min(have, default=100000)) + d(max(have, default=-100000))
        text = ["%6d" % (void if v is None else v) for v in col]
        out += (b + "".join(text[:FIRST_BLOCK])).ljust(RECORD).encode()
        for at in range(FIRST_BLOCK, rows, LATER_BLOCK):
            out += "".join(text[at : at + LATER_BLOCK]).ljust(RECORD).encode()
    return out


def encode_tiles(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """``cells(file, i, j, elev)`` and ``heads(file, title, zone, x0, y0, res)`` -> ``(file, content)``: a classic model of each
    tile. A tile's cells are together, as a file is written from end to end."""
    rows = cells.groupBy("file", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "elev"))), lambda t: t["elev"]).alias("row"))
    tiles = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda t: t["row"]).alias("grid")).join(heads, "file")

    def run(batches):
        for b in batches:
            data = [encode(t, int(z), x, y, r, [[None if pd.isna(v) else int(v) for v in row] for row in g]) for t, z, x, y, r, g in zip(b["title"], b["zone"], b["x0"], b["y0"], b["res"], b["grid"], strict=True)]
            yield pd.DataFrame({"file": b["file"], "content": data})

    return tiles.select("file", "title", "zone", "x0", "y0", "res", "grid").mapInPandas(run, "file string, content binary")


def one_degree(title: str, cols: int, rows: int) -> None:
    """Refuses what is no one-degree model: it has 1201 rows and 401, 601 or 1201 columns, and a sheet code in its title."""
    if rows != 1201 or cols not in (401, 601, 1201):
        raise ValueError(f"a one-degree model has 1201 rows and 401, 601 or 1201 columns, not {rows} and {cols}")
    if not re.search(r"[NS][A-Z]\d\d-\d\d[EW]", title):
        raise ValueError("the title holds no sheet code")


def read_one_degree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One-degree models in one call: ``(tile, seq, sw_lat, sw_lon, ne_lat, ne_lon, rows, cols)`` and
    ``(tile, i, j, elev)``, narrow ones with columns set between theirs. Files of another shape are left out."""
    from ..functions.geodesy import sheet_corners
    from ..operators.grid import interpolate_columns

    head = read_headers(spark, path).filter("plane_ref = 0").withColumn("at", sheet_corners(F.col("title")))
    good = head.filter("at is not null and cols in (401, 601, 1201)").select("file", "cols", "plane_ref", "elev_units", F.lit(3.0 / 3600).alias("y_res"), F.when(F.col("cols") > 0, F.lit(1.0) / (F.col("cols") - 1)).alias("x_res"), "at.*")
    some = read_profiles(spark, path).join(good.select("file"), "file", "left_semi")
    each = some.join(good.select("file", "elev_units"), "file").select("file", "elev_units", F.col("col").alias("j"), F.posexplode("samples").alias("k", "v"))
    metres = F.when(F.col("elev_units") == 1, F.round(F.col("v") * FOOT).cast("int")).otherwise(F.col("v"))
    cells = each.select("file", (1200 - F.col("k")).alias("i"), "j", F.when(~F.col("v").isin(*VOIDS), metres).alias("elev"))
    out = None
    for n, times in ((1201, 1), (601, 2), (401, 3)):
        own = cells.join(good.filter(F.col("cols") == n).select("file"), "file", "left_semi")
        # A row of one file is one row of the grid that is widened.
        wide = own if times == 1 else interpolate_columns(own.withColumn("i", F.struct("file", "i")), times).select("i.file", "i.i", "j", "elev")
        wide = wide.select("file", "i", "j", "elev")
        out = wide if out is None else out.union(wide)
    tiles = good.select(F.col("file").alias("tile"), F.dense_rank().over(_by_file()).alias("seq"), *(F.col(c).cast("double").alias(c) for c in ("sw_lat", "sw_lon", "ne_lat", "ne_lon")), F.lit(1201).alias("rows"), F.lit(1201).alias("cols"))
    return tiles, out.select(F.col("file").alias("tile"), "i", "j", "elev")


def _by_file():
    from pyspark.sql.window import Window

    return Window.orderBy("file")  # a row per file


def unblock(data: bytes, record: int = RECORD, check_blank: bool = True) -> bytes:
    """Sets the last byte of every record to a newline; a file that has newlines already is refused."""
    if b"\n" in data:
        raise ValueError("the file has newlines already")
    if check_blank and any(data[k] != 0x20 for k in range(record - 1, len(data), record)):
        raise ValueError("the last byte of a record is not blank")
    out = bytearray(data)
    out[record - 1 :: record] = b"\n" * len(out[record - 1 :: record])
    return bytes(out)


def unblock_graph(data: bytes) -> bytes:
    """The same for line graphs of 80-byte records, whatever their last byte."""
    return unblock(data, 80, check_blank=False)


def tile_header(text: str) -> dict:
    """Keys and values of a 30-arc-second tile's header, checked, with the corners of its outer edge."""
    h = {k.upper(): v for k, v in re.findall(r"(?m)^\s*(\w+)\s+(\S+)", text)}
    need = ("NROWS", "NCOLS", "NBITS", "ULXMAP", "ULYMAP", "XDIM", "YDIM")
    if any(k not in h for k in need):
        raise ValueError("the header lacks " + ", ".join(k for k in need if k not in h))
    if h.get("BYTEORDER", "M") != "M" or int(h.get("NBANDS", 1)) != 1 or int(h["NBITS"]) not in (8, 16):
        raise ValueError("only big-endian tiles of one band of 8 or 16 bits are read")
    width = int(h["NCOLS"]) * int(h["NBITS"]) // 8
    if int(h.get("BANDROWBYTES", width)) != width or int(h.get("TOTALROWBYTES", width)) != width:
        raise ValueError("row sizes do not agree")
    x, y, dx, dy = (float(h[k]) for k in ("ULXMAP", "ULYMAP", "XDIM", "YDIM"))
    rows, cols = int(h["NROWS"]), int(h["NCOLS"])
    west, north = x - dx / 2, y + dy / 2
    return {"rows": rows, "cols": cols, "bits": int(h["NBITS"]), "nodata": int(float(h.get("NODATA", -9999))), "nw_lat": north, "nw_lon": west, "se_lat": float(math.floor(north - dy * rows + 0.5)), "se_lon": float(math.floor(west + dx * cols + 0.5)), "x_res": dx, "y_res": dy}


def tile_window(head: dict, south: float, west: float, north: float, east: float) -> tuple[int, int, int, int] | None:
    """The rows and columns (ends excluded) of a tile that lie in a box; none where the two do not overlap."""
    if head["se_lat"] >= north or head["nw_lat"] <= south or head["nw_lon"] >= east or head["se_lon"] <= west:
        return None
    row = lambda lat: math.floor(head["rows"] * (head["nw_lat"] - lat) / (head["nw_lat"] - head["se_lat"]) + 0.5)
    col = lambda lon: math.floor(head["cols"] * (lon - head["nw_lon"]) / (head["se_lon"] - head["nw_lon"]) + 0.5)
    return row(min(north, head["nw_lat"])), row(max(south, head["se_lat"])), col(max(west, head["nw_lon"])), col(min(east, head["se_lon"]))


def tile_cells(data: bytes, head: dict, window: tuple[int, int, int, int] | None = None, edge: bool = False):
    """Yields a frame per row of the window (rows and columns, ends excluded): north first, no data is 0.

    With ``edge`` one more row and column follow, those next to the window or, where the tile ends, its last ones again.
    An empty window has none.
    """
    i0, i1, j0, j1 = window or (0, head["rows"], 0, head["cols"])
    i0, i1, j0, j1 = max(0, i0), min(i1, head["rows"]), max(0, j0), min(j1, head["cols"])
    kind, step = (">i2", 2) if head["bits"] == 16 else ("u1", 1)
    if i0 >= i1 or j0 >= j1:
        return
    j = np.arange(j0, j1 + edge, dtype=np.int32)
    for i in range(i0, i1 + edge):
        at = min(i, head["rows"] - 1) * head["cols"] * step
        row = np.frombuffer(data, kind, head["cols"], at)[np.minimum(j, head["cols"] - 1)].astype(np.int32)
        yield pd.DataFrame({"i": np.int32(i), "j": j, "elev": np.where(row == head["nodata"], 0, row)})


def read_tile(spark: SparkSession, hdr_path: str, dem_path: str, window=None, edge: bool = False) -> DataFrame:
    """Cells of one tile; the window limits the rows and columns that leave the reader, to which ``edge`` adds one each."""
    head = tile_header("\n".join(r.value for r in spark.read.text(hdr_path).limit(200).collect()))

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                for f in tile_cells(unpack(c), head, window, edge):
                    yield f.assign(file=p)[["file", "i", "j", "elev"]]

    return spark.read.format("binaryFile").load(dem_path).select("path", "content").mapInPandas(run, CELLS)
