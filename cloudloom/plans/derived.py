"""The derived point clouds: integer expressions over lineitem that give a closed domed box for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bit depth of the derived clouds: all coordinates are below 2 ** DEPTH.
DEPTH = 6


def _raw(spark: SparkSession, sf_dir: str, thick: bool) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bump = F.expr("((pu - 16) * (pu - 16) + (pv - 16) * (pv - 16)) div 64")
    if thick:
        bump = bump + F.col("l_quantity").cast("int") % 8
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_partkey") % 32).alias("pu"), (F.col("l_orderkey") % 32).alias("pv"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 6).alias("face")).withColumn("bump", bump)
    face, up, down = F.col("face"), 48 - F.col("bump"), 8 + F.col("bump")
    x = F.when(face == 0, up).when(face == 3, down).otherwise(12 + F.col("pu"))
    y = F.when(face == 1, up).when(face == 4, down).otherwise(12 + F.col("pv"))
    z = F.when(face == 2, up).when(face == 5, down).when(face.isin(0, 3), 12 + F.col("pu")).otherwise(12 + F.col("pv"))
    return rows.select((F.col("l_linenumber") - 1).alias("frame_id"), x.alias("x"), y.alias("y"), z.alias("z"), "face", (F.col("l_orderkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b"))


def cloud(spark: SparkSession, sf_dir: str, thick: bool = False) -> DataFrame:
    """points(frame_id, pt_idx, x, y, z, r, g, b, ppi), all int; ppi is the face that a point came from."""
    points = _raw(spark, sf_dir, thick).groupBy("frame_id", "x", "y", "z").agg(F.min("face").alias("ppi"), *(F.min(c).alias(c) for c in "rgb"))
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("x", "y", "z")) - 1
    points = points.withColumn("pt_idx", number)
    return points.select(*(F.col(c).cast("int").alias(c) for c in ("frame_id", "pt_idx", "x", "y", "z", "r", "g", "b", "ppi")))


def oracle(thick: bool = False) -> str:
    """DuckDB CTEs that define pc as cloud() does; ends without a comma."""
    more = " + l_quantity::int % 8" if thick else ""
    return f"""raw as (select *, ((pu - 16) * (pu - 16) + (pv - 16) * (pv - 16)) // 64{more} as bump from (select *, l_partkey % 32 as pu, l_orderkey % 32 as pv, (l_suppkey + l_orderkey) % 6 as face from lineitem)),
placed as (select l_linenumber - 1 as frame_id, face, l_orderkey % 256 as r, l_partkey % 256 as g, l_suppkey % 256 as b,
 case face when 0 then 48 - bump when 3 then 8 + bump else 12 + pu end as x, case face when 1 then 48 - bump when 4 then 8 + bump else 12 + pv end as y,
 case when face = 2 then 48 - bump when face = 5 then 8 + bump when face in (0, 3) then 12 + pu else 12 + pv end as z from raw),
pc as (select frame_id::int as frame_id, (row_number() over (partition by frame_id order by x, y, z) - 1)::int as pt_idx, x::int as x, y::int as y, z::int as z, min(r)::int as r, min(g)::int as g, min(b)::int as b, min(face)::int as ppi from placed group by frame_id, x, y, z)"""
