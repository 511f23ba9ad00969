"""The inferred path: one kernel a frame against the same steps as tables, statuses, funnels."""

import pytest
from pyspark.sql import functions as F

from pointloom.config import SPARSE, Attachment
from pointloom.operators import corridor, detect, ground, inferred, pairs
from pointloom.plans import registry

TABLES = "/root/testdata/sf0.001"
NAMES = ["frame_index", "hypothesis", "candidate_id", "kind", "branch", "label", "unique_xyz", "extent_s_m", "extent_l_m", "extent_h_m", "s_min_m", "l_min_m", "h_min_m",
    "range_from_sensor_m", "model_id", "members"]


@pytest.fixture(scope="module")
def stages(spark):
    """Stages of the driver's smallest cloud, with a ground as rough as ``band`` for every second frame."""
    pts, tracks, lines, residual, frag, sec = registry.paired(spark, TABLES)
    of = F.format_string("H%d-%d", "a_track", "b_track").alias("hypothesis")
    mid = pairs.agreeing(sec).select("frame_index", of, F.col("s_center").alias("s"), F.col("mid_l").alias("l")).cache()
    scored = pairs.scores(sec, residual, pairs.assumed_sections(frag)).withColumn("hypothesis", of).cache()
    rough = residual.withColumn("p95_m", F.when(F.col("frame_index") % 2 == 0, F.greatest("p95_m", F.lit(0.06))).otherwise(F.col("p95_m"))).cache()
    return ground.above_ground(pts, lines, SPARSE).cache(), lines.cache(), rough, frag.cache(), mid, scored


def as_tables(points, lines, residual, frag, mid, scored):
    """Candidates of every hypothesis by the operators on tables, one hypothesis after the other."""
    vertex = corridor.vertices(mid, lines, cfg=SPARSE).cache()
    relation = corridor.classify(points, corridor.segments(vertex), vertex).select("frame_index", "hypothesis", "point_id", (F.col("relation") == "inside").alias("inside")).cache()
    samples = pairs.line_samples(scored, frag, lines, SPARSE).cache()
    out = []
    for (name,) in scored.select("hypothesis").distinct().collect():
        own = points.join(relation.where(F.col("hypothesis") == name).drop("hypothesis"), ["frame_index", "point_id"])
        marks = detect.surface_masks(detect.line_masks(own, samples.where(F.col("hypothesis") == name).drop("hypothesis")), residual).cache()
        out += [tuple(r) for r in detect.straight_candidates(marks).withColumn("hypothesis", F.lit(name)).select(*NAMES).collect()]
    return vertex, out


def close(a, b):
    return all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_one_kernel_a_frame_equals_the_tables(spark, stages):
    points, lines, residual, frag, mid, scored = stages
    _, expected = as_tables(*stages)
    paths, _ = inferred.paths_of(mid, scored, frag, lines, residual, SPARSE)
    found = [tuple(r) for r in inferred.candidates(inferred.detect(points, paths)).select(*NAMES).collect()]
    key = lambda r: r[:3]
    assert [key(r) for r in sorted(found, key=key)] == [key(r) for r in sorted(expected, key=key)]
    assert all(close(a, b) for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True))
    assert {r[4] for r in found} == {"volume_or_suspended", "local_protrusion"} or any(r[4] == "volume_or_suspended" for r in found)


def test_funnel_and_counts(spark, stages):
    points, lines, residual, frag, mid, scored = stages
    paths, vertex = inferred.paths_of(mid, scored, frag, lines, residual, SPARSE)
    known = inferred.hypotheses(scored, vertex)
    detected = inferred.detect(points, paths.join(inferred.usable(known), ["frame_index", "hypothesis"], "left_semi"))
    rows = inferred.counted(known, detected).collect()
    n = {(r.frame_index, r.hypothesis): r for r in inferred.candidates(detected).groupBy("frame_index", "hypothesis").agg(F.count("*").alias("n")).collect()}
    assert len(rows) == scored.count() and any(r.in_layer for r in rows)
    for r in rows:
        assert r.points >= r.in_volume >= r.off_lines >= r.off_surface >= r.in_pool and r.off_surface - r.in_pool == r.in_layer >= r.protruding
        own = n.get((r.frame_index, r.hypothesis))
        assert r.volume_large + r.volume_rare + r.protrusion_large + r.protrusion_rare == (own.n if own else 0)


def test_hypotheses_that_miss_the_attachment_are_not_looked_at(spark):
    scored = spark.createDataFrame([(0, "A", "consistent", 0.9, 0), (0, "B", "ambiguous", 0.5, 1), (1, "A", "consistent", 0.9, 0)], "frame_index long, hypothesis string, kind string, score double, penalties int")
    mid = spark.createDataFrame([(f, h, s, l) for f, h, l in ((0, "A", 0.0), (0, "B", 0.6), (1, "A", 0.6)) for s in (6.0, 10.0, 15.0)], "frame_index long, hypothesis string, s double, l double")  # noqa: E741
    lines = spark.createDataFrame([(f, k, -1.0, 0.0, -3.0, 3.0) for f in (0, 1) for k in range(13)], "frame_index long, segment int, intercept double, slope_dh_dl double, l_min double, l_max double")
    match = corridor.attachment_match(mid, Attachment(6.0, 0.0, 5.0, 16.0))
    rows = {(r.frame_index, r.hypothesis): r for r in inferred.hypotheses(scored, corridor.vertices(mid, lines), match).collect()}
    assert (rows[0, "A"].attachment_compatible, rows[0, "A"].geometry_applicable, rows[0, "A"].observed_s_max_m) == (True, True, 15.0)
    assert (rows[0, "B"].attachment_compatible, rows[0, "B"].geometry_applicable, rows[0, "B"].observed_s_max_m) == (False, None, None)
    frames = spark.createDataFrame([(0, True), (1, True), (2, True), (3, False)], "frame_index long, ground_found boolean")
    known = inferred.hypotheses(scored, corridor.vertices(mid, lines), match)
    told = {r.frame_index: r.status for r in inferred.frame_statuses(frames, known, attached=True).collect()}
    assert told == {0: "ok", 1: "attachment_conflict", 2: "attachment_conflict", 3: "insufficient_geometry"}


def test_statuses_without_an_attachment(spark):
    frames = spark.createDataFrame([(k, k != 3) for k in range(4)], "frame_index long, ground_found boolean")
    known = spark.createDataFrame([(0, "A", True, True), (0, "B", True, False), (2, "A", True, False), (3, "A", True, True)], "frame_index long, hypothesis string, attachment_compatible boolean, geometry_applicable boolean")
    told = {r.frame_index: (r.status, r.hypotheses, r.applicable) for r in inferred.frame_statuses(frames, known).collect()}
    assert told == {0: ("ok", 2, 1), 1: ("no_hypotheses", 0, 0), 2: ("insufficient_geometry", 1, 0), 3: ("insufficient_geometry", 1, 1)}


def test_without_observed_ground_nothing_is_applicable(spark):
    scored = spark.createDataFrame([(0, "A", "consistent", 0.9, 0)], "frame_index long, hypothesis string, kind string, score double, penalties int")
    mid = spark.createDataFrame([(0, "A", s, 0.0) for s in (6.0, 10.0)], "frame_index long, hypothesis string, s double, l double")
    lines = spark.createDataFrame([], "frame_index long, segment int, intercept double, slope_dh_dl double, l_min double, l_max double")
    r = inferred.hypotheses(scored, corridor.vertices(mid, lines)).first()
    assert (r.attachment_compatible, r.geometry_applicable) == (True, False)


def test_empty_frames(spark, stages):
    points, lines, residual, frag, mid, scored = stages
    paths, _ = inferred.paths_of(mid, scored, frag, lines, residual, SPARSE)
    assert inferred.detect(points.where("false"), paths).collect() == [] and inferred.detect(points, paths.where("false")).collect() == []
    far = inferred.detect(points.withColumn("s", F.col("s") + 500), paths).collect()
    assert far and not any(r.in_volume for r in far)


def test_cards_of_the_inferred_path(spark):
    cards = registry.queries()["inferred_decisions"](spark, TABLES).collect()
    assert {r.decision for r in cards} <= {"insufficient_evidence", "insufficient_geometry"} and not any(r.intrusions for r in cards)
    assert len(cards) == len({r.frame_index for r in cards})
