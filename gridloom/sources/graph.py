"""Line graphs of 80-byte records (nodes, areas, lines) and attribute rule files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iso8211 import unpack

RECORD = 80
SCHEMA = "file string, kind string, id int, start_node int, end_node int, left_area int, right_area int, pts array<struct<x:double,y:double>>, attrs array<struct<major:int,minor:int>>"
WORDS, PAIRS, POINTS = 12, 6, 3
CORNERS = ("sw", "nw", "ne", "se")
HEADER = "file string, name string, postal string, plane_ref int, zone int, datum int, theme string, " + ", ".join(f"{k}_{c} double" for c in CORNERS for k in ("lat", "lon", "x", "y")) + ", n_nodes int, n_areas int, n_lines int, linefeeds boolean, reject string"


def _records(data: bytes) -> list[str]:
    text = unpack(data).decode("latin-1")
    if "\n" in text[:200]:
        return [x.rstrip("\r").ljust(RECORD) for x in text.rstrip("\r\n \x1a").split("\n")]
    return [text[k : k + RECORD].ljust(RECORD) for k in range(0, len(text), RECORD)]


def _int(s: str) -> int:
    m = re.match(r"\s*[-+]?\d+", s)
    return int(m[0]) if m else 0


def _field(v: float, width: int, spec: str = "d") -> str:
    text = f"{v:{width}{spec}}"
    if len(text) > width:
        raise ValueError(f"{v} does not fit {width} characters")
    return text


def parse_header(data: bytes) -> dict:
    """What the fifteen records ahead of the nodes say, by the names of HEADER but for file.

    The second record holds the name, a comma and postal codes up to two blanks. Datum 0 is NAD-27, 1 NAD-83; blank is 0.
    reject says why a file cannot be drawn: not in UTM, a zone outside 1 to 60, or cut short; it is null otherwise.
    """
    recs = _records(data)
    out = dict.fromkeys(x.split()[0] for x in HEADER.split(", ")[1:])
    out["linefeeds"] = b"\n" in unpack(data)[:200]
    if len(recs) < 15:
        return out | {"reject": "fewer than 15 header records"}
    name, comma, rest = recs[1].partition(",")
    out |= {"name": name.strip(), "postal": rest.strip().partition("  ")[0] if comma else ""}
    out |= {"plane_ref": _int(recs[3][6:12]), "zone": _int(recs[3][12:18]), "datum": _int(recs[3][66:69])}
    for c, rec in zip(CORNERS, recs[10:14], strict=True):
        nums = [float(v.replace("D", "E")) for v in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[DE][-+]?\d+)?", rec[6:])]
        out |= {f"{k}_{c}": v for k, v in zip(("lat", "lon", "x", "y"), nums, strict=False)}
    out |= {"theme": recs[14][:20].strip(), "n_nodes": _int(recs[14][24:30]), "n_areas": _int(recs[14][40:46]), "n_lines": _int(recs[14][56:62])}
    if out["plane_ref"] != 1:
        out["reject"] = f"ground reference system {out['plane_ref']} is not UTM"
    elif not 1 <= out["zone"] <= 60:
        out["reject"] = f"no zone {out['zone']}"
    elif any(out[f"{k}_{c}"] is None for c in CORNERS for k in ("lat", "lon", "x", "y")):
        out["reject"] = "a corner is not complete"
    return out


def encode_header(head: dict, n_nodes: int, n_areas: int, n_lines: int) -> list[str]:
    """The fifteen records that ``parse_header`` reads; names that ``head`` lacks or has as null are taken as blank, zone and
    coordinates as 0, the reference system as UTM."""
    get = lambda k, other: other if head.get(k) is None else head[k]
    exp = lambda v, width, digits: f"{v:{width}.{digits}E}".replace("E", "D")
    dms = lambda v: (-1 if v < 0 else 1) * ((round(abs(v) * 3600, 6) // 3600) * 1e6 + (round(abs(v) * 3600, 6) // 60 % 60) * 1e3 + round(abs(v) * 3600, 6) % 60)
    middle = [(get(f"{k}_sw", 0.0) + get(f"{k}_ne", 0.0)) / 2 for k in ("lon", "lat")]
    zeros = exp(0.0, 24, 15) * 3
    out = ["", f"{get('name', '')}, {get('postal', '')}", "", f"{3:6d}{get('plane_ref', 1):6d}{get('zone', 0):6d}{2:6d}{exp(0.61, 18, 11)}{4:6d}{0:6d}{4:6d}{1:6d}{get('datum', 0):3d}{0:3d}"]
    out += [exp(dms(middle[0]), 24, 15) + exp(dms(middle[1]), 24, 15) + exp(0.0, 24, 15), zeros, zeros, zeros, zeros]
    out.append("".join(exp(v, 18, 11) for v in (1.0, 0.0, 0.0, 0.0)))
    for c in CORNERS:
        lat, lon, x, y = (get(f"{k}_{c}", 0.0) for k in ("lat", "lon", "x", "y"))
        out.append(f"{c.upper()}    {lat:12.6f}{lon:12.6f}{'':6}{x:12.2f}{y:12.2f}")
    out.append(f"{get('theme', ''):20.20}   0{_field(n_nodes, 6) * 2} 010{_field(n_areas, 6) * 2} 010{_field(n_lines, 6) * 2}   1")
    return [x[:RECORD].ljust(RECORD) for x in out]


def parse(data: bytes, head: int = 15):
    """Yields (kind, id, start, end, left, right, points, attributes) for N, A and L records and what continues them.

    Points of lines are whole metres; those of nodes and areas are as written. All attributes are kept, however many
    records they take.
    """
    recs = _records(data)
    at = head

    def take(n: int, per: int, width: int) -> list[str]:
        nonlocal at
        out: list[str] = []
        while len(out) < n and at < len(recs):
            r = recs[at]
            out += [r[k * width : (k + 1) * width] for k in range(min(per, n - len(out)))]
            at += 1
        return out

    while at < len(recs):
        r = recs[at]
        at += 1
        kind = r[0]
        if kind in "NA":
            x, y, n_lines, n_attrs = float(r[6:18] or 0), float(r[18:30] or 0), _int(r[36:42]), _int(r[48:54])
            take(n_lines, WORDS, 6)
            attrs = take(2 * n_attrs, 2 * PAIRS, 6)
            yield kind, _int(r[1:6]), None, None, None, None, [(x, y)], _pairs(attrs)
        elif kind == "L":
            ids = [_int(r[a:b]) for a, b in ((1, 6), (6, 12), (12, 18), (18, 24), (24, 30))]
            n_pts, n_attrs = _int(r[42:48]), _int(r[48:54])
            nums = take(2 * n_pts, 2 * POINTS, 12)
            attrs = take(2 * n_attrs, 2 * PAIRS, 6)
            pts = [(float(int(float(nums[k]))), float(int(float(nums[k + 1])))) for k in range(0, len(nums) - 1, 2)]
            yield kind, *ids, pts, _pairs(attrs)


def _pairs(words: list[str]) -> list[tuple[int, int]]:
    return [(_int(words[k]), _int(words[k + 1])) for k in range(0, len(words) - 1, 2)]


def encode(name: str, nodes: list, areas: list, lines: list, header: dict | None = None) -> bytes:
    """The optional format: nodes (id, x, y, attrs), areas (id, x, y, attrs, and a ring of signed line ids with 0 before each
    island, which may be left out), lines (id, start, end, left, right, pts, attrs), and a header as of ``parse_header``.

    A node lists the lines that start there, and those that end there as negative. A number wider than its field is refused.
    """
    out = encode_header({"name": name} | (header or {}), len(nodes), len(areas), len(lines))
    at_node: dict[int, list[int]] = {}
    for i, a, b, *_ in lines:
        at_node.setdefault(a, []).append(i)
        at_node.setdefault(b, []).append(-i)

    def put(words: list[str], per: int) -> None:
        out.extend("".join(words[k : k + per]).ljust(RECORD) for k in range(0, len(words), per))

    flat = lambda attrs: [_field(v, 6) for p in attrs for v in p]

    def point(kind: str, i: int, x: float, y: float, attrs: list, ring: list) -> None:
        out.append(f"{kind}{_field(i, 5)}{_field(x, 12, '.2f')}{_field(y, 12, '.2f')}{'':6}{_field(len(ring), 6)}{'':6}{_field(len(attrs), 6)}{ring.count(0) if kind == 'A' else 0:12d}".ljust(RECORD))
        put([_field(v, 6) for v in ring], WORDS)
        put(flat(attrs), 2 * PAIRS)

    for i, x, y, attrs in nodes:
        point("N", i, x, y, attrs, at_node.get(i, []))
    for i, x, y, attrs, *ring in areas:
        point("A", i, x, y, attrs, list(ring[0]) if ring else [])
    for i, a, b, left, right, pts, attrs in lines:
        out.append(f"L{_field(i, 5)}{''.join(_field(v, 6) for v in (a, b, left, right))}{'':12}{_field(len(pts), 6)}{_field(len(attrs), 6)}".ljust(RECORD))
        put([_field(v, 12, ".2f") for p in pts for v in p], 2 * POINTS)
        put(flat(attrs), 2 * PAIRS)
    return "".join(out).encode("latin-1", "replace")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADER per file, those that cannot be drawn too, with their reason in reject."""

    def run(batches):
        for b in batches:
            rows = [{"file": p} | parse_header(c) for p, c in zip(b["path"], b["content"], strict=True)]
            got = pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")])
            yield got.astype({k: "Int32" for k in ("plane_ref", "zone", "datum", "n_nodes", "n_areas", "n_lines")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, HEADER)


def encode_graphs(features: DataFrame, heads: DataFrame, rings: DataFrame) -> DataFrame:
    """``features`` as of ``read``, ``heads`` as of ``read_headers`` and ``rings(file, area, ring)`` -> ``(file, content)``: a
    line graph of each head, in order of id. A file's features are together, as it is written from end to end."""
    ring = rings.select("file", F.col("area").alias("id"), F.lit("A").alias("kind"), "ring")
    each = features.join(ring, ["file", "kind", "id"], "left").select("file", F.struct("kind", "id", "start_node", "end_node", "left_area", "right_area", "pts", "attrs", "ring").alias("f"))
    packed = heads.join(each.groupBy("file").agg(F.array_sort(F.collect_list("f")).alias("fs")), "file", "left")
    wide = packed.select("file", F.struct(*[c for c in heads.columns if c not in ("file", "reject")]).alias("head"), "fs")

    def run(batches):
        for b in batches:
            data = []
            for head, fs in zip(b["head"], b["fs"], strict=True):
                fs = [] if fs is None else [dict(f) for f in fs]
                attrs = lambda f: [(a["major"], a["minor"]) for a in f["attrs"]] if f["attrs"] is not None else []
                spots = {k: [(f["id"], f["pts"][0]["x"], f["pts"][0]["y"], attrs(f), *([] if k == "N" or f["ring"] is None else [[int(v) for v in f["ring"]]])) for f in fs if f["kind"] == k] for k in "NA"}
                lines = [(*(int(f[c]) for c in ("id", "start_node", "end_node", "left_area", "right_area")), [(p["x"], p["y"]) for p in f["pts"]], attrs(f)) for f in fs if f["kind"] == "L"]
                head = {k: None if v is None or v != v else int(v) if k in ("plane_ref", "zone", "datum") else v for k, v in dict(head).items()}
                data.append(encode(head.get("name") or "", spots["N"], spots["A"], lines, head))
            yield pd.DataFrame({"file": b["file"], "content": data})

    return wide.mapInPandas(run, "file string, content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (N), areas (A) and lines (L) of every file, one file to a task: records continue each other."""

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows = [(p, k, i, s, e, le, ri, [{"x": x, "y": y} for x, y in pts], [{"major": m, "minor": n} for m, n in at]) for k, i, s, e, le, ri, pts, at in parse(c)]
                got = pd.DataFrame(rows, columns=["file", "kind", "id", "start_node", "end_node", "left_area", "right_area", "pts", "attrs"])
                yield got.astype({k: "Int32" for k in ("start_node", "end_node", "left_area", "right_area")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, major, minor)`` of lines that begin with N, A or L; N rules select nothing and are dropped."""
    line = r"^([AL])\s+(-?\d+)\s+(-?\d+)"
    text = spark.read.text(path)
    return text.filter(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("kind"), F.regexp_extract("value", line, 2).cast("int").alias("major"), F.regexp_extract("value", line, 3).cast("int").alias("minor"))
