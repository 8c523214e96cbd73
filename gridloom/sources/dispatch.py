"""Which reader a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_of(path: Column) -> Column:
    """struct<fmt, gz>: a .ddf file of a CE.. module is an SDTS grid, other .ddf an SDTS graph, .hdr a 30-arc-second tile."""
    gz = path.rlike("\\.(gz|GZ)$")
    bare = F.regexp_replace(path, "\\.(gz|GZ)$", "")
    fmt = F.when(bare.rlike("(?i)CE.{2}\\.ddf$"), "sdts_dem").when(bare.rlike("(?i)\\.ddf$"), "sdts_dlg").when(bare.rlike("(?i)\\.hdr$"), "gtopo30").otherwise("classic")
    return F.struct(fmt.alias("fmt"), gz.alias("gz"))


def companion(path: Column, module: str) -> Column:
    """The path of another module of an SDTS transfer: its four characters before .ddf, keeping case of the rest."""
    return F.regexp_replace(path, "(?i)[A-Z0-9]{4}(\\.ddf(?:\\.gz)?)$", module + "$1")
