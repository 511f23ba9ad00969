import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import cloud

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(0, k, *[None if v is None else float(v) for v in r[:4]], *r[4:]) for k, r in enumerate(rows)], "frame_index long, source_index long, x float, y float, z float, intensity float, ring int, timestamp double")


def test_valid_keeps_single_zeros_and_drops_origin_and_missing(spark):
    df = frame(spark, [(0.0, 0.0, 0.0, 1.0, 0, 0.0), (0.0, 1.0, 0.0, 1.0, 0, 0.0), (NAN, 1.0, 1.0, 1.0, 0, 0.0), (float("inf"), 1.0, 1.0, 1.0, 0, 0.0), (1.0, 1.0, None, 1.0, 0, 0.0)])
    assert [r.source_index for r in cloud.valid(df).collect()] == [1]


def test_groups_spans_members(spark):
    df = frame(spark, [(1, 2, 3, 5.0, 1, 0.1), (4, 5, 6, NAN, 2, 0.2), (1, 2, 3, 7.5, 2, 0.4), (1, 2, 3, NAN, 1, 0.3)])
    g = {r.first_index: r for r in cloud.group_exact(df).collect()}
    assert (g[0]["size"], g[0].member_index, g[0].intensity_span, g[0].ring_nunique) == (3, [0, 2, 3], 2.5, 2)
    assert g[0].timestamp_span == pytest.approx(0.3)
    assert (g[1]["size"], g[1].intensity_span) == (1, 0.0)  # a single record spans 0 even where the value is missing
    missing = frame(spark, [(1, 1, 1, NAN, 0, 0.0), (1, 1, 1, NAN, 0, 0.0)])
    assert math.isnan(cloud.group_exact(missing).first().intensity_span)
    assert cloud.group_exact(df.drop("ring", "timestamp")).first().ring_nunique == -1


def test_members_expand_to_records(spark):
    g = spark.createDataFrame([(0, True, [10, 12]), (0, False, [11])], "frame_index long, vote boolean, member_index array<long>")
    assert [(r.source_index, r.vote) for r in cloud.expand_members(g, "vote").collect()] == [(10, True), (12, True), (11, False)]


def test_frames_round_trip_and_gate(spark):
    df = spark.createDataFrame([(0, 1.0, -2.0, 3.0)], "frame_index long, x double, y double, z double")
    r = cloud.to_sensor(cloud.to_working(df).drop("x", "y", "z")).first()
    assert (r.x, r.y, r.z) == (1.0, -2.0, 3.0)
    m = cloud.Mount(0.35, 0, 1, 0.1, 0.2, 0.12, True, "organizer", "stated")
    back = cloud.train_to_sensor(cloud.sensor_to_train(df, m), m).first()
    assert (back.x, back.y, back.z) == pytest.approx((1.0, -2.0, 3.0))
    assert cloud.working_frame(df, m).first().coordinate_frame == "train_working"
    for bad in (cloud.Mount(confirmed=False, source="organizer", basis="x"), cloud.Mount(confirmed=True, source="guess", basis="x"), cloud.Mount(confirmed=True, source="organizer", basis=" ")):
        assert cloud.working_frame(df, bad).first().coordinate_frame == "sensor_working_prior_mount_unconfirmed"


def test_azimuth_wraps_to_minus_180(spark):
    df = spark.createDataFrame([(0, -10.0, 0.0, 0.0)], "frame_index long, x double, y double, z double")
    assert cloud.angles(df).first().azimuth_deg == -180.0


def test_grouping_does_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.lit(0).cast("long").alias("frame_index"), F.col("id").alias("source_index"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(3))).cast("float").alias(c) for c in "xyz"])
    a = sorted(map(str, cloud.group_exact(df.repartition(1)).collect()))
    assert a == sorted(map(str, cloud.group_exact(df.repartition(7)).collect()))
