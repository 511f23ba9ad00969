"""Functions and table functions by name from SQL text, against the operators."""

import pytest
from pyspark.sql import functions as F

from pointloom.functions import scalars, sql
from pointloom.operators import detect, spatial
from pointloom.plans import registry

TABLES = "/root/testdata/sf0.001"
NAMES = ["frame_index", "candidate_id", "kind", "branch", "unique_xyz", "extent_s_m", "extent_l_m", "extent_h_m", "s_min_m", "range_from_sensor_m", "model_id"]


@pytest.fixture(scope="module")
def marked(spark):
    assert "volume_candidates" in sql.register(spark)
    rough = registry.marked(spark, TABLES, coarse_m=0.06)[1].cache()
    rough.createOrReplaceTempView("marked")
    return rough


@pytest.mark.parametrize(("variant", "fit", "protrusions"), [("B", "baseline", False), ("C", "baseline", True), ("C", "span_limit", True), ("C", "ransac", True)])
def test_candidates_by_name(spark, marked, variant, fit, protrusions):
    told = spark.sql(f"SELECT {', '.join(NAMES)} FROM volume_candidates(TABLE(marked), variant => '{variant}', fit => '{fit}')")
    want = detect.straight_candidates(marked, fit, protrusions).select(*NAMES)
    flat = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert flat(told) == flat(want) and told.count() > 0


def test_defaults_and_joins_in_sql(spark, marked):
    n = spark.sql("SELECT count(*) AS n FROM volume_candidates(TABLE(SELECT *, 1 AS candidate_id FROM marked)) c JOIN (SELECT DISTINCT frame_index FROM marked) USING (frame_index)").first().n
    assert n == detect.straight_candidates(marked).count()


@pytest.mark.parametrize(("call", "message"), [("TABLE(marked), variant => 'Z'", "unknown variant Z"), ("TABLE(SELECT frame_index, s FROM marked)", "needs the columns point_id"), ("TABLE(marked), fit => 'guess'", "unknown fit")])
def test_errors_are_told_before_the_query_runs(spark, marked, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM volume_candidates({call})")


def test_scalars_by_name(spark, marked):
    pts = marked.select("s", "l", "h").limit(500).cache()
    pts.createOrReplaceTempView("some_points")
    by_name = spark.sql("SELECT in_profile(s, l, h) AS a, link_radius_m(s, l, h) AS b, range_m(s, l, h) AS c, wrap_degrees(100 * s) AS d, lerp(s, l, 0.25) AS e FROM some_points")
    by_column = pts.select(detect.in_profile().alias("a"), spatial.link_radius().alias("b"), F.sqrt(F.col("s") * F.col("s") + F.col("l") * F.col("l") + F.col("h") * F.col("h")).alias("c"),
        scalars.wrap_degrees(100 * F.col("s")).alias("d"), scalars.lerp(F.col("s"), F.col("l"), F.lit(0.25)).alias("e"))
    assert sorted(map(tuple, by_name.collect())) == sorted(map(tuple, by_column.collect()))
    assert "PythonUDF" not in by_name._jdf.queryExecution().toString()
    r = spark.sql("SELECT if_finite(double('NaN')) AS a, if_finite(double('infinity')) AS b, if_finite(2.5D) AS c").first()
    assert (r.a, r.b, r.c) == (None, None, 2.5)
    same = spark.range(3).selectExpr("row_identity(concat_ws('|', 'a', id)) AS x").collect()
    assert same == spark.range(3).select(F.substring(F.sha2(F.concat_ws("|", F.lit("a"), "id"), 256), 1, 16).alias("x")).collect()
