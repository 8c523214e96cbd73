"""Views that make grids, points, lines and attributes of the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (24.0 + (k * 37 % 2500) / 100.0).alias("lat"), (-125.0 + (k * 91 % 5800) / 100.0).alias("lon"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("class"))


def grid_cells(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.floor(k / 100).cast("int").alias("i"), (k % 100).cast("int").alias("j"), F.when(k % 17 != 3, F.round(F.col("o_totalprice") / 150).cast("int") - 100).alias("elev"), F.substring("o_orderpriority", 1, 1).cast("int").alias("seq"))


def line_pts(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # the window comes first: what is made of its columns needs no shuffle
    placed = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumn("pos", F.row_number().over(w))
    return placed.select(F.col("l_orderkey").alias("line"), "pos", F.col("l_partkey").cast("double").alias("x"), (F.col("l_suppkey") * 20).cast("double").alias("y"))


def line_attrs(spark, d):
    major = F.when(F.col("l_returnflag") == "R", 50).when(F.col("l_returnflag") == "A", 170).otherwise(180)
    each = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", F.struct(major.alias("major"), (200 + F.col("l_linenumber")).alias("minor")).alias("a"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "a"))), lambda t: t["a"]).alias("attrs"))


def topology(spark, d):
    code = lambda s: F.when(s == "F", 1).when(s == "O", 2).otherwise(3)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("start_node"), (F.col("o_custkey") * 7 % 1500).alias("end_node"), code(F.col("o_orderstatus")).alias("left_area"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("right_area"), F.col("o_totalprice").alias("top"))


SQL = {
    "geo_points": "select c_custkey as id, 24.0::double + (c_custkey * 37 % 2500)::double / 100 as lat, -125.0::double + (c_custkey * 91 % 5800)::double / 100 as lon, c_name as name, c_mktsegment as class from customer",
    "grid_cells": "select cast(floor(o_orderkey / 100.0::double) as int) as i, cast(o_orderkey % 100 as int) as j, case when o_orderkey % 17 <> 3 then cast(round(o_totalprice / 150) as int) - 100 end as elev, cast(substr(o_orderpriority, 1, 1) as int) as seq from orders",
    "line_pts": "select l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, l_partkey::double as x, (l_suppkey * 20)::double as y from lineitem",
    "line_attr": "select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k, case l_returnflag when 'R' then 50 when 'A' then 170 else 180 end as major, 200 + l_linenumber as minor from lineitem",
    "topology": "select o_orderkey as id, o_custkey as start_node, o_custkey * 7 % 1500 as end_node, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as left_area, cast(o_orderkey % 4 + 1 as int) as right_area, o_totalprice as top from orders",
}


def with_views(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
