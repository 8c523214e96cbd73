"""Writers at the edge: raster image, grey map, converted files. Each refuses to overwrite."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color

# Magic number of the raster format, its type and colour-map codes.
MAGIC, STANDARD, RGB_MAP = 0x59A66A95, 1, 1


def rasterfile(path: str, width: int, height: int, palette: list[tuple[int, int, int]], pixels: DataFrame, background: int = 246) -> None:
    """``pixels(x, y, color)`` as an 8-bit image: eight big-endian numbers, three maps of 256, rows of even length.

    Rows come to the driver one partition at a time, so it holds the image and no more.
    """
    wide = width + width % 2
    canvas = bytearray([background]) * (wide * height)
    for r in pixels.filter(f"x between 0 and {width - 1} and y between 0 and {height - 1}").select("x", "y", "color").toLocalIterator():
        canvas[r.y * wide + r.x] = r.color
    full = [*palette, *[(0, 0, 0)] * (256 - len(palette))]
    with open(path, "xb") as f:
        f.write(struct.pack(">8I", MAGIC, width, height, 8, wide * height, STANDARD, RGB_MAP, 768))
        f.write(bytes(c[k] for k in range(3) for c in full))
        f.write(canvas)


def grey_map(path: str, heights: DataFrame, comment: str = "") -> None:
    """``heights(i, j, height)`` as text P2, row by row, with a largest value of 65535."""
    rows = heights.groupBy("i").count().count()
    cols = heights.groupBy("j").count().count()
    with open(path, "x") as f:
        f.write("P2\n" + "".join(f"# {x}\n" for x in comment.splitlines()) + f"{cols} {rows}\n65535\n")
        for r in heights.orderBy("i", "j").toLocalIterator():
            f.write(f"{r.height}\n")


def write_bytes(path: str, data: bytes) -> None:
    with open(path, "xb") as f:
        f.write(data)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """``(file, content)`` into a folder that all executors share, each under the last part of its name; returns ``(file, bytes)``.
    A file that is there is not overwritten."""

    def run(batches):
        import os

        import pandas as pd

        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                write_bytes(os.path.join(folder, name.rpartition("/")[2]), bytes(content))
            yield pd.DataFrame({"file": b["file"], "bytes": [len(c) for c in b["content"]]})

    return files.select("file", "content").mapInPandas(run, "file string, bytes long")


def write_lines(lines: DataFrame, folder: str, column: str = "raw") -> None:
    """One column of text, unchanged, as Spark writes it; a folder that is there is not overwritten."""
    lines.select(F.col(column).alias("value")).write.mode("errorifexists").text(folder)


def model_line(file: Column, title: Column, corners: tuple[Column, Column, Column, Column], low: Column, high: Column, cols: Column, rows: Column, feeds: Column) -> Column:
    """What an elevation model is, in one line: file, title, south-east and north-west corner, range, size, line ends."""
    from ..operators.image import general

    where = F.concat_ws(":", *(general(c, 6) for c in corners))
    return F.concat_ws("\t", file, F.lpad(F.substring(title, 1, 40), 40, " "), where, F.concat_ws(":", low.cast("string"), high.cast("string")), F.concat_ws(":", cols.cast("string"), rows.cast("string")), F.when(feeds, "linefeeds=yes").otherwise("linefeeds=no"))


def graph_line(file: Column, name: Column, theme: Column, corners: tuple[Column, Column, Column, Column], feeds: Column, postal: Column | None = None) -> Column:
    """The same for a line graph: file, name, postal codes where they are given, theme, south-east and north-west corner, line ends."""
    from ..operators.image import general

    where = F.concat_ws(":", *(general(c, 6) for c in corners))
    return F.concat_ws("\t", file, F.trim(name), *([] if postal is None else [postal]), F.rtrim(F.substring(theme, 1, 20)), where, F.when(feeds, "linefeeds=yes").otherwise("linefeeds=no"))


def scene(low: int, high: int, height_field: str, palette: int = color.DEFAULT_PALETTE, sea: tuple[int, int, int] = (50, 50, 255)) -> str:
    """A ray-tracer's scene over a height field: a texture for water and one for each band up to the highest elevation."""
    high = max(1, high)
    paint = lambda name, rgb: f"#declare {name} = texture {{ pigment {{ color rgb<{', '.join(f'{v / 255:g}' for v in rgb)}> }} }}"
    lines = ['#include "colors.inc"', paint("Water", sea), *(paint(f"Band{k}", rgb) for k, rgb in enumerate(color.PALETTES[palette]))]
    starts = [limit / high for limit in color.LIMITS[:-1]]
    layers = ["[ 0.0 Water ]", "[ 0.000001 Band0 ]", *(f"[ {v:g} Band{k} ]" for k, v in enumerate(starts, 1) if v <= 1)]
    lines += ["camera { location <0.5, 15, -16> look_at 0 angle 30 }", "light_source { <-1000, 1000, -1000> White }", f"// Elevations from {low} to {high}.", f'height_field {{ pgm "{height_field}" water_level {low / high:g} smooth']
    lines += ["  texture { gradient y texture_map {", *(f"    {x}" for x in layers), "  } }", "  translate <-0.5, -0.5, -0.5> scale <10, 0.8, 10>", "}"]
    return "\n".join(lines) + "\n"
