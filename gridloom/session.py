"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridloom", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
