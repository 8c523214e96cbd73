"""Place-name search over a stream of text files: stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import gnis


def search_stream(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Unchanged lines of new files whose place lies in the box."""
    lines = spark.readStream.text(path).withColumnRenamed("value", "raw")
    return gnis.search(gnis.parse(lines).filter("reason is null"), box).select("raw")
