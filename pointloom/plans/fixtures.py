"""Point clouds derived from the driver's tables by plain arithmetic, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise, table

#: The cloud of ``lineitem``: a floor, two lines, a ceiling and a box in each frame; DIV is the engine's integer division.
CLOUD_SQL = """
with k as (select *, cast(round(l_extendedprice*100) as bigint) c, cast(l_quantity as bigint) qq,
                  cast(round(l_tax*100) as bigint) tx, cast(round(l_discount*100) as bigint) dc from lineitem),
u as (select l_suppkey fr, qq q, tx, dc, l_linenumber ln, (c*31 + l_orderkey*17 + l_partkey*7) % 10007 a,
             (c*13 + l_orderkey*29 + l_linenumber*101) % 10009 b from k),
p as (select fr as frame_index, q, ln, a, b,
 case when q<=34 then 5 + 25*(a/10007.0e0)
      when q<=40 then (case a%5 when 0 then 6 when 1 then 10 when 2 then 15 when 3 then 20 else 25 end) + 0.8e0*(b/10009.0e0) - 0.4e0
      when q<=44 then 5 + 25*(a/10007.0e0) else 12 + 0.2e0*(a/10007.0e0) end as s,
 case when q<=34 or (q>40 and q<=44) then -3 + 6*(b/10009.0e0)
      when q<=40 then (case when (a DIV 5)%2=0 then -0.76e0 else 0.76e0 end) + 0.06e0*(b/10009.0e0) - 0.03e0
      else -0.3e0 + 0.6e0*(b/10009.0e0) end as l,
 case when q<=34 then -1.0e0 + 0.00125e0*tx when q<=40 then -0.88e0 + 0.002e0*tx
      when q<=44 then 2.5e0 + 0.002e0*tx else -0.80e0 + 0.06e0*dc end as h from u)
select frame_index, q, l as x, -s as y, h as z, s, l, h, sqrt(s*s + l*l + h*h) as range_m, cast(ln as int) as ring, a/10007.0e0 as intensity,
  row_number() over (partition by frame_index order by s, l, h, q, ln, a, b) as source_index from p
"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: frame_index, source_index, x, y, z, ring, intensity, and s, l, h, range_m."""
    return cloud_of(table(spark, sf_dir, "lineitem"))


def cloud_of(lineitem: DataFrame) -> DataFrame:
    """The same from rows of ``lineitem``; whole frames of it give the same records."""
    return lineitem.sparkSession.sql(CLOUD_SQL.replace("DIV", "div").replace("from lineitem", "from {lineitem}"), lineitem=lineitem)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud as a table of its own, as recorded points are.

    A filter on coordinates goes below the projection that derives them, and would compute each several times over, in code too long to be compiled.
    """
    return materialise(cloud(spark, sf_dir), "cloud")


def grouped(records: DataFrame, dealt: bool = False) -> DataFrame:
    """Distinct places of a frame as rows with ``point_id``, in the order of (s, l, h); all of it dealt by frame.

    ``dealt``: the records are so already, as after a window over their frames.
    """
    rows = records.withColumns({"s": -F.col("y"), "l": F.col("x"), "h": F.col("z")})
    rows = rows.withColumn("range_m", F.sqrt(F.col("s") * F.col("s") + F.col("l") * F.col("l") + F.col("h") * F.col("h")))
    kept = [F.min(c).alias(n) for c, n in (("range_m", "range_m"), ("source_index", "first_index"), ("q", "q")) if c in rows.columns]
    g = (rows if dealt else rows.repartition("frame_index")).groupBy("frame_index", "s", "l", "h").agg(*kept)
    return g.withColumn("point_id", F.row_number().over(Window.partitionBy("frame_index").orderBy("s", "l", "h")).cast("long"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud's distinct places; records are not numbered first, as that would sort them all once more."""
    return grouped(cloud(spark, sf_dir).drop("source_index"))


#: The same in DuckDB, as common table expressions.
DUCK_CLOUD = "cloud as (" + CLOUD_SQL.replace("DIV", "//") + ")"
DUCK_POINTS = DUCK_CLOUD + """,
pts as (select *, row_number() over (partition by frame_index order by s, l, h) as point_id from
  (select frame_index, s, l, h, min(range_m) as range_m, min(source_index) as first_index, min(q) as q from cloud group by all))
"""
