"""SDTS transfers: from the stream of subfields to headers, cells, lines, nodes, areas and attributes, by DataFrame operations.

Input is ``(file, module, rec, seq, tag, label, format, value)`` of all modules of a transfer, ``file`` naming the transfer
(``transfers`` makes it from the paths of ``iso8211.read``). A subfield counts only where tag, label and the letter of
its format fit: A text, I whole number, R real, B binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import attributes as codes

NO_DATA, FOOT = 32767, 0.3048
# Words of reference systems, datums, units and the beginnings of producers' names.
SYSTEMS = (("GEO", 0), ("UTM", 1), ("SPCS", 2))
HORIZONTAL = (("NAS", 1), ("WGC", 2), ("WGE", 3), ("NAX", 4), ("OHD", 5), ("PRD", 6))
GRAPH_DATUMS = (("NAS", 0), ("NAX", 1), ("Puerto Rico", 2), ("Old Hawaiian", 3), ("Local (Astro)", 4))
VERTICAL = (("LMSL", 1), ("NGVD", 2), ("NAVD", 3))
UNITS = (("FEET", 1), ("METERS", 2))
PRODUCERS = (("Unspecified", ""), ("National M", "NMD"), ("Eastern Ma", "EMC"), ("Western Ma", "WMC"), ("Mid-Contin", "MCMC"), ("Rocky Moun", "RMMC"), ("Forest Ser", "FS"), ("Gestalt Ph", "GPM2"), ("Contractor", "CONT"))
CORNERS = ("sw", "nw", "ne", "se")


def layer_of(path: Column, digits: int = 1) -> Column:
    """The record of the header module that a cell (one digit, counted from 0) or line module (two digits) belongs to."""
    n = F.regexp_extract(path, rf"(?i)(\d{{{digits}}})\.ddf(?:\.gz)?$", 1).try_cast("int")
    return n + 1 if digits == 1 else n


def transfers(subfields: DataFrame) -> DataFrame:
    """Names the transfer in ``file``: the path without the module's four characters and the ending."""
    return subfields.withColumn("file", F.regexp_replace("file", r"(?i)[A-Z0-9]{4}\.ddf(?:\.gz)?$", ""))


def forward_fill(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], mark: Column, name: str) -> DataFrame:
    """Adds the last ``mark`` that is not null up to each row, as a record's number holds for what follows it."""
    return rows.withColumn(name, F.last(mark, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order)))


def whole(value: Column) -> Column:
    """A big-endian two's complement number of 2 or 4 bytes."""
    n, size = F.conv(F.hex(value), 16, 10).cast("long"), F.octet_length(value)
    return F.when(size == 2, F.when(n >= 1 << 15, n - (1 << 16)).otherwise(n)).when(size == 4, F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n))


def real32(value: Column) -> Column:
    """A big-endian IEEE number of 4 bytes; those that are no numbers, or not finite, are null."""
    n = F.conv(F.hex(value), 16, 10).cast("long")
    e, m = F.shiftright(n, 23).bitwiseAND(F.lit(255)), n.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    size = F.when(e == 0, m * 2.0**-149).when(e < 255, (1 + m / float(1 << 23)) * F.pow(F.lit(2.0), (e - 127).cast("double")))
    return F.when(F.octet_length(value) == 4, F.when(n >= 1 << 31, -size).otherwise(size))


def text_of(value: Column) -> Column:
    return F.trim(F.decode(value, "ISO-8859-1"))


def number_of(value: Column, fmt: Column) -> Column:
    return F.when(fmt.contains("B"), whole(value).cast("double")).otherwise(text_of(value).try_cast("double"))


def _is(tag: str, label: str, kinds: str = "") -> Column:
    ok = (F.col("tag") == tag) & (F.col("label") == label)
    return ok & F.col("format").rlike(f"[{kinds}]") if kinds else ok


def _text(tag: str, label: str, also: Column | None = None) -> Column:
    ok = _is(tag, label, "A")
    return F.min(F.when(ok if also is None else ok & also, F.struct("rec", "seq", text_of(F.col("value")).alias("v"))))["v"]


def _num(tag: str, label: str, kinds: str = "IRB", also: Column | None = None) -> Column:
    ok = _is(tag, label, kinds)
    return F.min(F.when(ok if also is None else ok & also, F.struct("rec", "seq", number_of(F.col("value"), F.col("format")).alias("v"))))["v"]


def _listed(tag: str, label: str, kinds: str = "IRB", text: bool = False) -> Column:
    """All values of a record in their order."""
    v = text_of(F.col("value")) if text else number_of(F.col("value"), F.col("format"))
    return F.transform(F.array_sort(F.collect_list(F.when(_is(tag, label, kinds), F.struct("rec", "seq", v.alias("v"))))), lambda t: t["v"])


def _word(v: Column, words) -> Column:
    """The code of a word; -1 for another or none."""
    out = F.lit(-1)
    for w, code in words:
        out = F.when(v == w, F.lit(code)).otherwise(out)
    return out


def rmse(text: Column, of: str) -> Column:
    """struct<x, y, z, size, stats> out of the accuracy report; of: 'absolute datum' or "file's datum". All 0 where it says nothing."""
    near = of.replace("'", ".") + r" \(x.*?\( *"
    num = lambda k: F.coalesce(F.regexp_extract(text, near + r"(\d+)[, ] *(\d+)[, ] *(\d+)", k).try_cast("int"), F.lit(0))
    end = near + r"\d+[, ] *\d+[, ] *\d+.*?\); "
    size = F.coalesce(F.regexp_extract(text, end + r"accuracy has been.*?size of *(\d+)", 1).try_cast("int"), F.lit(0))
    known = text.rlike(end + "accuracy is estimated") | text.rlike(end + "accuracy has been.*?size of ")
    return F.struct(num(1).alias("x"), num(2).alias("y"), num(3).alias("z"), size.alias("size"), known.cast("int").alias("stats"))


def producer(text: Column) -> Column:
    """The code of at most four characters of a model's producer; another name's first four."""
    name = F.regexp_extract(text, r"^DEM PRODUCER:  (.*)", 1)
    out = F.substring(name, 1, 4)
    for words, code in PRODUCERS:
        out = F.when(name.startswith(words), F.lit(code)).otherwise(out)
    return out


def scaled(v: Column, scale: Column, origin: Column) -> Column:
    return v * scale + origin


def snapped(v: Column, res: Column, up: bool) -> Column:
    """To the next multiple of the spacing: up for the first column, down for the first row."""
    return (F.ceil(v / res) if up else F.floor(v / res)) * res


def dem_meta(subfields: DataFrame, layer: int = 1) -> DataFrame:
    """A row per transfer of an elevation model with what its modules say; ``missing`` names what no model can do without.

    Some values go by their order: the corners are south-west, north-west, north-east, south-east, the domain values void,
    edge, least and greatest. A transfer with something missing is to be rejected (``rejects``).
    """
    m, rec = F.col("module"), F.col("rec")
    own = m == "SPDM"
    corner_rec = F.col("rec_id") == layer
    by = forward_fill(subfields, ("file", "module", "rec"), ("seq",), F.when(F.col("label") == "RCID", text_of(F.col("value")).try_cast("int")), "rec_id")
    by = by.withColumn("rec_id", F.coalesce("rec_id", rec))
    corner = lambda c: F.transform(F.array_sort(F.collect_list(F.when(own & corner_rec & _is("DMSA", c, "RB"), F.struct("rec", "seq", number_of(F.col("value"), F.col("format")).alias("v"))))), lambda t: t["v"])
    quality, history = F.col("module") == "DQPA", F.col("module") == "DQHL"
    got = by.groupBy("file").agg(
        _text("IDEN", "TITL").alias("title"),
        _text("DQPA", "COMT", quality & (F.col("rec_id") == 1)).alias("level_text"),
        _text("DQPA", "COMT", quality & (F.col("rec_id") == 2)).alias("accuracy_text"),
        _text("XREF", "RSNM").alias("rsnm"), _num("XREF", "ZONE", "I").alias("zone"), _text("XREF", "HDAT").alias("hdat"), _text("XREF", "COMT").alias("xref_text"), _text("VATT", "VDAT").alias("vdat"),
        corner("X").alias("xs"), corner("Y").alias("ys"), _listed("DDOM", "DVAL", "IR").alias("domain"),
        *(_num("IREF", k, "R").alias(k.lower()) for k in ("XHRS", "YHRS", "SFAX", "SFAY", "XORG", "YORG")),
        _text("DDSH", "UNIT").alias("unit"), _num("DDSH", "PREC", "R").alias("z_res"), _num("LDEF", "NROW", "I").alias("nrow"), _num("LDEF", "NCOL", "I").alias("ncol"),
        _num("SADR", "X", "RB", m == "RSDF").alias("first_x"), _num("SADR", "Y", "RB", m == "RSDF").alias("first_y"), F.max(F.when((m == "RSDF") & _is("SADR", "X"), F.col("format").contains("B"))).alias("binary"), _text("RSDF", "OBRP").alias("obrp"),
        _text("DQHL", "COMT", history & (F.col("rec_id") == 3)).alias("producer_text"), _text("DQHL", "COMT", history & (F.col("rec_id") == 2)).alias("process_text"),
    )
    c = F.col
    shift = F.regexp_extract(F.substring("xref_text", 21, 10), r"(\d[-.\d]*)", 1).try_cast("double")
    x, y = scaled(c("first_x"), c("sfax"), c("xorg")), scaled(c("first_y"), c("sfay"), c("yorg"))
    need = ("title", "rsnm", "hdat", "xhrs", "yhrs", "sfax", "sfay", "xorg", "yorg", "unit", "z_res", "nrow", "ncol", "first_x", "first_y", "obrp")
    lacks = F.filter(F.array(*(F.when(c(k).isNull(), F.lit(k)) for k in need), F.when(F.size("xs") < 4, F.lit("corners")), F.when(F.size("domain") < 4, F.lit("domain"))), lambda k: k.isNotNull())
    return got.select(
        "file", "title", F.coalesce(F.regexp_extract("level_text", r"DEM LEVEL (\d)", 1).try_cast("int"), F.lit(-1)).alias("level"),
        F.when(c("accuracy_text").startswith("ACCURACY: Unspecified"), 0).otherwise(1).alias("accuracy"), rmse(c("accuracy_text"), "absolute datum").alias("datum_rmse"), rmse(c("accuracy_text"), "file's datum").alias("dem_rmse"),
        _word(c("rsnm"), SYSTEMS).alias("plane_ref"), c("zone").cast("int").alias("zone"), _word(c("hdat"), HORIZONTAL).alias("h_datum"), _word(c("vdat"), VERTICAL).alias("v_datum"), F.when(c("xref_text").startswith("V"), shift).alias("v_shift"),
        *(F.get(c(f"{a}s"), F.lit(k)).alias(f"{name}_{a}") for k, name in enumerate(CORNERS) for a in "xy"),
        *(F.round(F.get("domain", F.lit(k))).cast("int").alias(name) for k, name in enumerate(("void_fill", "edge_fill", "min_elev", "max_elev"))),
        c("xhrs").alias("x_res"), c("yhrs").alias("y_res"), "z_res", _word(c("unit"), UNITS).alias("elev_units"), c("nrow").cast("int").alias("rows"), c("ncol").cast("int").alias("cols"),
        F.when(c("binary"), snapped(x, c("xhrs"), True)).otherwise(c("first_x")).alias("x_first"), F.when(c("binary"), snapped(y, c("yhrs"), False)).otherwise(c("first_y")).alias("y_first"),
        (c("obrp") == "G2").alias("regular"), producer(c("producer_text")).alias("origin"), F.substring("process_text", 14, 1).try_cast("int").alias("process_code"), lacks.alias("missing"),
    )


def rejects(meta: DataFrame) -> DataFrame:
    """``(source, reason)`` of transfers that lack something, or whose model is not regular."""
    why = F.when(F.size("missing") > 0, F.concat(F.lit("lacks "), F.array_join("missing", ", "))).when(~F.coalesce("regular", F.lit(False)), F.lit("not a regular grid"))
    return meta.select(F.col("file").alias("source"), why.alias("reason")).filter("reason is not null")


def dem_cells(subfields: DataFrame, meta: DataFrame) -> DataFrame:
    """``(file, i, j, elev)``: a record of the cell module per row, in order. The edge value and 32767 are no data, the void
    value is 0, feet become metres. ``meta`` is a row per transfer and is joined as the plan sees fit."""
    raw = subfields.filter(_is("CVLS", "ELEVATION", "B"))
    w = Window.partitionBy("file", "rec").orderBy("seq")
    placed = raw.select("file", "rec", F.row_number().over(w).alias("n"), "value", "format")
    v = F.when(F.octet_length("value") == 2, whole(F.col("value")).cast("double")).otherwise(real32(F.col("value")))
    met = placed.select("file", (F.col("rec") - 1).alias("i"), (F.col("n") - 1).alias("j"), F.round(v).cast("int").alias("v")).join(meta.select("file", "void_fill", "edge_fill", "elev_units", "rows", "cols"), "file").filter("i < rows and j < cols")
    metres = F.when(F.col("elev_units") == 1, F.round(F.col("v") * FOOT).cast("int")).otherwise(F.col("v"))
    elev = F.when((F.col("v") == F.col("edge_fill")) | (F.col("v") == NO_DATA), F.lit(None).cast("int")).when(F.col("v") == F.col("void_fill"), F.lit(0)).otherwise(metres)
    return met.select("file", "i", "j", elev.alias("elev"))


def frame(subfields: DataFrame) -> DataFrame:
    """``(file, sfax, sfay, xorg, yorg)`` of each transfer."""
    some = subfields.filter("module = 'IREF'")
    return some.groupBy("file").agg(*(_num("IREF", k, "R").alias(k.lower()) for k in ("SFAX", "SFAY", "XORG", "YORG")))


def _features(subfields: DataFrame, prefix: str, id_tag: str) -> DataFrame:
    """A row per record of the modules that begin with ``prefix``: its number, links and points in their own units."""
    some = subfields.filter(F.col("module").startswith(prefix))
    one = lambda tag: _num(tag, "RCID", "I").cast("long")
    return some.groupBy("file", "module", "rec").agg(
        one(id_tag).alias("id"), one("PIDL").alias("left_area"), one("PIDR").alias("right_area"), one("SNID").alias("start_node"), one("ENID").alias("end_node"), one("ARID").alias("arid"),
        _listed("ATID", "MODN", "A", text=True).alias("mods"), _listed("ATID", "RCID", "I").alias("recs"), _listed("SADR", "X").alias("xs"), _listed("SADR", "Y").alias("ys"),
    ).filter("id is not null")


def _points(rows: DataFrame, ref: DataFrame) -> DataFrame:
    met = rows.join(ref, "file")
    return met.withColumn("pts", F.transform(F.arrays_zip("xs", "ys"), lambda t: F.struct(scaled(t["xs"], F.col("sfax"), F.col("xorg")).alias("x"), scaled(t["ys"], F.col("sfay"), F.col("yorg")).alias("y"))))


def links(subfields: DataFrame, prefix: str, id_tag: str) -> DataFrame:
    """``(file, id, seq, module, rcid)``: the attribute records that each feature names, in order."""
    each = _features(subfields, prefix, id_tag).select("file", "id", F.posexplode(F.arrays_zip("mods", "recs")).alias("seq", "t"))
    return each.select("file", "id", "seq", F.col("t.mods").alias("module"), F.col("t.recs").cast("long").alias("rcid"))


def lines(subfields: DataFrame) -> DataFrame:
    """``(file, id, start_node, end_node, left_area, right_area, pts)`` of line modules, and of entity nodes as lines of two
    equal points whose both sides are the node's area."""
    ref = frame(subfields)
    cols = ("file", "id", "start_node", "end_node", "left_area", "right_area", "pts")
    real = _points(_features(subfields, "LE", "LINE"), ref).select(*cols)
    single = _points(_features(subfields, "NE", "PNTS"), ref).filter(F.size("pts") > 0)
    p = F.get("pts", F.lit(0))
    return real.union(single.select("file", "id", F.col("id").alias("start_node"), F.col("id").alias("end_node"), F.col("arid").alias("left_area"), F.col("arid").alias("right_area"), F.array(p, p).alias("pts")))


def nodes(subfields: DataFrame) -> DataFrame:
    """``(file, kind, id, x, y)`` of NO and NE modules together."""
    ref = frame(subfields)
    out = None
    for kind in ("NO", "NE"):
        one = _points(_features(subfields, kind, "PNTS"), ref).select("file", F.lit(kind).alias("kind"), "id", F.get("pts", F.lit(0))["x"].alias("x"), F.get("pts", F.lit(0))["y"].alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def corners(subfields: DataFrame) -> DataFrame:
    """``(file, corner, x, y)`` of the corner points of a graph, by their record numbers."""
    each = _points(_features(subfields, "NP", "PNTS"), frame(subfields)).filter("id between 1 and 4")
    return each.select("file", F.element_at(F.array(*map(F.lit, CORNERS)), F.col("id").cast("int")).alias("corner"), F.get("pts", F.lit(0))["x"].alias("x"), F.get("pts", F.lit(0))["y"].alias("y"))


def areas(subfields: DataFrame) -> DataFrame:
    """``(file, id, poly, x, y)`` of NA modules, after the universe, area 1 of no polygon at the south-west corner."""
    each = _points(_features(subfields, "NA", "PNTS"), frame(subfields)).select("file", "id", F.col("arid").alias("poly"), F.get("pts", F.lit(0))["x"].alias("x"), F.get("pts", F.lit(0))["y"].alias("y"))
    return corners(subfields).filter("corner = 'sw'").select("file", F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("poly"), "x", "y").union(each.filter("id <> 1"))


def polygons(subfields: DataFrame) -> DataFrame:
    """``(file, poly, seq, module, rcid)`` of PC modules."""
    return links(subfields, "PC", "POLY").withColumnRenamed("id", "poly")


def attribute_modules(subfields: DataFrame) -> DataFrame:
    """``(file, name)`` of the attribute modules that features name, each once, without unknown ones (A then three more characters)."""
    some = subfields.filter(F.col("module").rlike("^(LE|NO|NE|PC)") & _is("ATID", "MODN", "A"))
    return some.select("file", text_of(F.col("value")).alias("name")).filter(F.col("name").rlike("^A[A-Z0-9]{3}$")).distinct()


def themes(subfields: DataFrame) -> DataFrame:
    """``(file, name, theme, category)``: the catalogue's theme of each module, where it has one."""
    each = subfields.filter("module = 'CATS'").groupBy("file", "rec").agg(_text("CATS", "NAME").alias("name"), _text("CATS", "THEM").alias("theme"))
    return each.filter("name <> '' and theme <> ''").select("file", "name", F.substring("theme", 1, 20).alias("theme"), codes.theme_category(F.col("theme")).alias("category"))


def graph_header(subfields: DataFrame) -> DataFrame:
    """``(file, name, theme, scale, level, datum, zone, usable)``: the title ahead of its slash is the name, behind it the theme.
    Only UTM of zones 1 to 60 can be used."""
    got = subfields.groupBy("file").agg(_text("IDEN", "TITL").alias("title"), _text("IDEN", "SCAL").alias("scal"), _num("IDEN", "SCAL", "I").alias("scale"), _text("IDEN", "DAST").alias("dast"), _text("XREF", "HDAT").alias("hdat"), _text("XREF", "RSNM").alias("rsnm"), _num("XREF", "ZONE", "I").alias("zone"))
    part = lambda k: F.trim(F.coalesce(F.get(F.split("title", "/"), F.lit(k)), F.lit("")))
    ok = F.coalesce((F.col("rsnm") == "UTM") & F.col("zone").between(1, 60), F.lit(False))
    return got.select("file", part(0).alias("name"), part(1).alias("theme"), F.coalesce(F.col("scale"), F.col("scal").try_cast("double")).cast("long").alias("scale"), F.substring("dast", 5, 1).try_cast("int").alias("level"), _word(F.col("hdat"), GRAPH_DATUMS).alias("datum"), F.col("zone").cast("int").alias("zone"), ok.alias("usable"))


def attributes(subfields: DataFrame, modules: DataFrame) -> DataFrame:
    """``(file, module, rcid, k, major, minor)`` of the records of attribute modules; ``modules(file, name, category)``.

    A label ENTITY_LABEL holds its code, ROUTE_NUMBER and ROUTE_TYPE are routes, elevations of AHPR are metres and of AHPT
    feet, ACOI counts coincident features, ABDM holds an agency's number; all others go by the dictionary of their category.
    """
    own = subfields.join(modules.select("file", F.col("name").alias("module"), "category"), ["file", "module"])
    own = forward_fill(own, ("file", "module", "rec"), ("seq",), F.when(F.col("label") == "RCID", text_of(F.col("value")).try_cast("long")), "rcid").filter("label <> 'RCID' and rcid is not null")
    rows = own.select("file", "module", "rcid", "seq", "category", "label", text_of(F.col("value")).alias("value"))
    v, label, kind = F.col("value"), F.col("label"), F.substring("module", 1, 4)
    metres, feet = v.try_cast("double"), v.try_cast("double")
    some = lambda t: F.filter(F.array(t), lambda x: x["major"].isNotNull() & x["minor"].isNotNull())
    special = (
        F.when(label == "ENTITY_LABEL", some(codes.entity_label(v)))
        .when(label.startswith("ROUTE_NUMBER"), codes.route(v))
        .when(label.startswith("ROUTE_TYPE"), some(codes.route_type(v)))
        .when((kind == "AHPR") & label.startswith("ELEVATION"), some(codes.elevation_metres(metres)))
        .when((kind == "AHPT") & label.startswith("ELEVATION"), some(codes.elevation_feet(feet)))
        .when((kind == "ACOI") & label.startswith("COINCIDENT"), some(codes.coincident(F.col("category"), v.try_cast("int"))))
        .when((kind == "ABDM") & label.startswith("AGENCY"), some(F.struct(F.lit(97).alias("major"), v.try_cast("int").alias("minor"))))
    )
    named = rows.withColumn("special", special)
    direct = named.filter("special is not null").select("file", "module", "rcid", "seq", F.posexplode("special").alias("part", "t")).select("file", "module", "rcid", "seq", "part", "t.major", "t.minor")
    plain = codes.decode(named.filter("special is null").select("file", "module", "rcid", F.col("seq").alias("at"), "category", "label", "value"))
    both = direct.union(plain.select("file", "module", "rcid", F.col("at").alias("seq"), F.col("seq").alias("part"), "major", "minor"))
    w = Window.partitionBy("file", "module", "rcid").orderBy("seq", "part")
    return both.select("file", "module", "rcid", (F.row_number().over(w) - 1).alias("k"), "major", "minor")


def _sizes(subfields: DataFrame) -> DataFrame:
    """A row per record with what ``counts`` needs of ``_features``: whether it has a number, which one, and how many points and
    links. All aggregates are of fixed width, so records are put together by hashing ahead of the shuffle, without sorting
    and without their values."""
    some = subfields.filter(F.col("module").rlike("^(LE|NO|NE|NA|NP)"))
    value = number_of(F.col("value"), F.col("format"))
    id_of = lambda tag: F.min_by(F.when(_is(tag, "RCID", "I"), value), F.when(_is(tag, "RCID", "I"), F.col("seq"))).cast("long")
    many = lambda tag, label, kinds="IRB": F.count_if(_is(tag, label, kinds))
    return some.groupBy("file", F.substring("module", 1, 2).alias("kind"), "module", "rec").agg(
        id_of("LINE").alias("line"), id_of("PNTS").alias("point"),
        F.greatest(many("SADR", "X"), many("SADR", "Y")).alias("points"), F.greatest(many("ATID", "MODN", "A"), many("ATID", "RCID", "I")).alias("links"),
    )


def counts(subfields: DataFrame) -> DataFrame:
    """``(file, lines, nodes, areas, points, links)`` of a graph: how many rows ``lines``, ``nodes``, ``areas`` and ``links`` of LE
    have, out of one pass over the records."""
    kind, line, point = F.col("kind"), F.col("line").isNotNull(), F.col("point").isNotNull()
    real, single, node = (kind == "LE") & line, (kind == "NE") & point & (F.col("points") > 0), kind.isin("NO", "NE") & point
    area = ((kind == "NA") & (F.col("point") != 1)) | ((kind == "NP") & (F.col("point") == 1))
    sums = _sizes(subfields).groupBy("file").agg(
        F.count_if(real | single).alias("lines"), F.count_if(node).alias("nodes"), F.count_if(area).alias("areas"),
        F.sum(F.when(real, F.col("points")).when(single, 2).otherwise(0)).alias("points"), F.sum(F.when(real, F.col("links")).otherwise(0)).alias("links"),
    )
    return sums.filter("lines > 0").join(frame(subfields).select("file"), "file", "left_semi").select("file", *(F.col(k).cast("long").alias(k) for k in ("lines", "nodes", "areas", "points", "links")))
