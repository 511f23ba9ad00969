import pytest
from pyspark.sql import functions as F

from pointloom.operators import angular, cloud, evaluate, marks, pairs, rule
from pointloom.sources import journal

REC = "frame_index long, source_index long, x float, y float, z float, intensity float, ring int"


def records(spark, rows):
    return spark.createDataFrame([(0, k, *map(float, r[:3]), float(k), k % 3) for k, r in enumerate(rows)], REC)


def test_grid_keeps_every_return(spark):
    df = records(spark, [(10, 0, 0), (10.0, 0, 0), (20, 0, 0), (0, 5, 1), (-10, 0, 0), (0, 0, 0)])
    g = angular.grid(df).cache()
    assert g.count() == 5  # the origin has no direction
    assert g.where("source_index = 4").first().col == 0
    o = angular.occupancy(g).first()
    assert (o.points, o.collisions, o.multiple_returns, o.fullest) == (5, 1, 1, 3)
    assert (lambda r: (r.dropped, r.duplicated))(angular.audit(df, g).first()) == (1, 0)
    assert angular.audit(df, g.unionByName(g.limit(2))).first().duplicated == 2
    edge = angular.grid(records(spark, [(1, 0, 0), (0, 0, 1)]), 1.0)  # straight up is on the upper edge of the grid
    assert sorted(r.row for r in edge.collect()) == [0, 89]
    cells = spark.createDataFrame([(0, 5, 1), (0, 3, 1), (0, 4, 2)], "frame_index long, n int, cell int")
    assert [(r.cell, r.place) for r in angular.first_cells(cells, ["cell"], "n").orderBy("place").collect()] == [(1, 1), (2, 2)]
    r = {(x.row, x.col): x.value for x in angular.raster(g).collect()}
    assert len(r) == 3 and {x.value for x in angular.raster(g, "count").collect()} == {3.0, 1.0}
    flipped = angular.raster(g, "min", flip=True)
    assert flipped.agg(F.min("row")).first()[0] == 0
    assert angular.quantisation(g).first().max_m < 0.1
    assert angular.ring_grid(df).select("row").distinct().count() == 3


def test_display_sample_keeps_highlights(spark):
    df = spark.range(1000).select(F.lit(0).cast("long").alias("frame_index"), F.col("id").alias("source_index"))
    marked = spark.createDataFrame([(0, 3), (0, 999), (0, 500)], "frame_index long, source_index long")
    got = angular.display_sample(df, 10, marked).collect()
    assert {r.source_index for r in got if not r.label} == {int(k * 999 / 9) for k in range(9)}
    assert {r.source_index for r in got if r.label} == {3, 500, 999}
    assert angular.display_sample(df.where("source_index < 5"), 10, marked).count() == 5
    assert {r.source_index for r in angular.display_sample(df, 1, marked).collect()} == {0, 3, 500, 999}
    assert angular.display_sample(df.limit(1), 1, marked.where("false")).count() == 1
    assert angular.seeded_sample(df, 7).count() == 7 and angular.stride_sample(df, 100).count() == 10
    a = sorted(r.source_index for r in angular.seeded_sample(df.repartition(5), 7).collect())
    assert a == sorted(r.source_index for r in angular.seeded_sample(df, 7).collect())


def test_evidence_table_has_every_cell(spark):
    p = spark.createDataFrame([(0, "rail", 12.0), (0, "rail", 250.0)], "frame_index long, kind string, range_m double")
    m = spark.createDataFrame([(0, "rail", 1, True, "low"), (0, "rail", 1, False, "high")], "frame_index long, kind string, band int, visible boolean, confidence string")
    t = {(r.kind, r.band): (r.points, r.visible, r.confidence) for r in angular.evidence_table(p, ["rail", "floor", "wall"], m).collect()}
    assert len(t) == 18 and t["rail", 1] == (1, True, "high,low") and t["rail", 5][0] == 1 and t["wall", 0] == (0, None, None)


def test_marks(spark):
    m = spark.createDataFrame([(0, "rail", "high", 0, 1, 0, 1), (0, "tree", "high", 0, 1, 0, 1), (0, "wall", "sure", 0, 1, 0, 1), (0, "wall", "low", 3, 1, 0, 1), (0, "wall", "low", 0, 9, 0, 1)], "frame_index long, kind string, confidence string, row_lo int, row_hi int, col_lo int, col_hi int")
    assert sorted(r.problem for r in marks.mark_problems(m, 5, 5).collect()) == ["empty_area", "outside_of_grid", "unknown_confidence", "unknown_kind"]
    g = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 4, 4)], "frame_index long, source_index long, row int, col int")
    assert [(r.source_index, r.kind) for r in marks.marked_points(g, m.limit(1)).collect()] == [(1, "rail")]


def test_display_and_constants(spark):
    d = spark.createDataFrame([("conditional_intrusion", 98.7, True), ("candidate_only", None, False)], "decision string, nearest_intrusion_m double, delayed boolean")
    assert [r.text for r in marks.display_text(d).collect()] == ["delayed: conditional_intrusion at 98.7 m", "candidate_only"]
    p = spark.createDataFrame([(0, 0, 9, 1), (0, 1, 2, 2), (0, 1, 1, 3)], "slot int, session_id int, reception int, frame_index int")
    assert marks.newest_picture(p).first().frame_index == 2
    assert not marks.own_path(d).first().own_path_selected
    s = spark.createDataFrame([(31.0, None), (1.0, "bad"), (1.0, None)], "t double, e string").select(marks.status_of(F.col("t"), 30.0, F.col("e")).alias("s"))
    assert [r.s for r in s.collect()] == ["processing_timeout", "processing_error", "ok"]


def test_highlight_and_regions(spark):
    c = spark.createDataFrame([(0, "L1", 4, [1, 2, 3, 4]), (0, "R1", 2, [5, 6])], "frame_index long, candidate_id string, unique_xyz long, members array<long>")
    acc = spark.createDataFrame([(0, "R1")], "frame_index long, candidate_id string")
    assert sorted(r.source_index for r in marks.highlight(c, acc).collect()) == [5, 6]
    region = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4, 5, 6)], "frame_index long, point_id long")
    assert evaluate.region_hits(c, region).first().candidate_id == "L1"
    assert evaluate.prior_overlap(c, c.limit(1).withColumn("candidate_id", F.lit("old"))).first().common == 4


def test_separation_survives_shift_and_turn(spark):
    side = lambda l: spark.createDataFrame([(0, s, l) for s in (6.0, 10.0, 15.0, 20.0, 25.0)], "frame_index long, s double, l double")
    a, b = pairs.shifted(side(-0.76), 0.45, 0.12), pairs.shifted(side(0.76), 0.45, 0.12)
    got = [r.delta_l for r in pairs.same_place_cut(a, b, [8.0, 12.0, 18.0]).collect()]
    import math

    assert len(got) == 3 and all(x == pytest.approx(1.52 / math.cos(0.12)) for x in got)


def test_distance_survives_shift_and_yaw(spark):
    """Lines 1.52 m apart on a tilted plane, as the sensor sees them before and after it is moved and turned."""
    import math

    def line(l):  # noqa: E741
        return [(s, l, -1.30 + 0.001 * s + 0.04 * l) for s in (6.0, 10.0, 15.0, 20.0, 25.0)]

    def turned(p, shift, yaw):
        s, l, h = p  # noqa: E741
        x, y, c, k = l + shift, -s, math.cos(yaw), math.sin(yaw)
        return -(k * x + c * y), c * x - k * y, h

    cols = "frame_index long, " + ", ".join(f"{e}_{c} double" for e in "ab" for c in "slh")
    got = []
    for shift, yaw in ((0.0, 0.0), (0.45, math.radians(20))):
        rows = [(0, *turned(a, shift, yaw), *turned(b, shift, yaw)) for a, b in zip(line(-0.25), line(1.27))]
        got.append(pairs.distance_of_points(spark.createDataFrame(rows, cols), ["frame_index"]).first())
    assert got[0].distance_m == pytest.approx(got[1].distance_m, abs=1e-6) and got[0].distance_m > 1.52
    assert got[0].same_s_delta_l_m == pytest.approx(1.52) and got[0].points == 5


AXIS = "frame_index long, a_track int, b_track int, s_center double, mid_l double"


def assessed(spark, mids, kind="consistent", shared=0, own=True):
    rows = spark.createDataFrame([(0, 0, 1, float(s), float(m)) for s, m in mids], AXIS)
    ranked = spark.createDataFrame([(0, 0, 1, kind, shared)], "frame_index long, a_track int, b_track int, kind string, shared_with long")
    mine = spark.createDataFrame([(0, 0, 1)] if own else [], "frame_index long, a_track int, b_track int")
    return rule.axis_assessment(rows, ranked, mine).first()


def test_only_the_own_turning_track_forbids_the_profile(spark):
    bend = [(6, 0.0), (10, 0.0), (15, 1.0), (20, 2.0)]  # halves of slope 0 and 0.2
    r = assessed(spark, bend)
    assert (r.direction_change, r.forbids, r.reason) == (pytest.approx(0.2), True, "no_contradiction")
    assert (lambda r: (r.forbids, r.reason))(assessed(spark, bend, own=False)) == (False, "turns_of_unknown_owner")
    assert assessed(spark, bend, kind="ambiguous").reason == "weak_or_shared" and assessed(spark, bend, shared=1).reason == "weak_or_shared"
    assert assessed(spark, [(s, m + 1.2) for s, m in bend]).reason == "offset"  # a neighbouring track
    straight = assessed(spark, [(6, 0.0), (10, 0.8), (15, 1.8)])
    assert (straight.constant_heading, straight.turns, straight.reason) == (True, False, "constant_heading")
    assert assessed(spark, [(6, 0.0), (9, 0.9)]).weak and assessed(spark, [(6, 0.0)]).direction is None
    frames = spark.createDataFrame([(0,), (1,)], "frame_index long")
    axis = rule.axis_assessment(spark.createDataFrame([(0, 0, 1, float(s), float(m)) for s, m in bend], AXIS), spark.createDataFrame([(0, 0, 1, "consistent", 0)], "frame_index long, a_track int, b_track int, kind string, shared_with long"), spark.createDataFrame([(0, 0, 1)], "frame_index long, a_track int, b_track int"))
    assert {r.frame_index: r.profile_applicable for r in rule.applicable(frames, axis).collect()} == {0: False, 1: True}


def test_inventory_and_gates(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metadata.yaml").write_text("x: 1")
    roles = spark.createDataFrame([("a", "locked_test")], "run string, role string")
    assert sorted((r.run, r.role) for r in journal.inventory(spark, str(tmp_path), roles).collect()) == [("a", "locked_test"), ("b", "unassigned")]
    f = spark.createDataFrame([("processing_timeout", 0), ("candidate_only", 2)], "decision string, candidates int")
    assert [journal.search_gate(f, g).count() for g in ("none", "decided", "candidates")] == [2, 1, 1]
    with pytest.raises(ValueError):
        journal.same_identity(spark.createDataFrame([("x",)], "identity string"), "y")


def test_repeats(spark):
    df = records(spark, [(1, 2, 3), (4, 5, 6), (1, 2, 3), (1, 2, 3)])
    assert {(r["size"], r.groups) for r in cloud.repeat_summary(df).collect()} == {(3, 1), (1, 1)}
    assert [(r.lag, r.n) for r in cloud.repeat_lags(df).collect()] == [(1, 1), (2, 1)]
    r = cloud.repeat_at_offset(df, 2).first()
    assert (r.pairs, r.equal) == (2, 1)


def test_colours_limits_and_cells(spark):
    c = lambda v, lo, hi, *stops: tuple(spark.range(1).select(angular.colour(F.lit(v), F.lit(lo), F.lit(hi), *stops).alias("c")).first().c)
    assert c(0.0, 0.0, 4.0) == (30, 60, 140) and c(4.0, 0.0, 4.0) == (200, 50, 40) and c(9.0, 0.0, 4.0) == (200, 50, 40)
    assert c(0.5, 0.0, 4.0) == (35, 110, 160) and c(-3.0, 0.0, 4.0) == (30, 60, 140)
    assert c(5.5, 5.0, 5.0, angular.INTENSITY_STOPS) == (70, 70, 90)  # no length: one of 1
    v = spark.createDataFrame([(0, 2.0), (0, 5.0), (0, float("nan")), (1, float("inf")), (2, 3.0)], "frame_index long, v double")
    assert {r.frame_index: (r.low, r.high) for r in angular.limits(v, "v").collect()} == {0: (1.0, 6.0), 1: (-1.0, 1.0), 2: (2.0, 5.0)}
    cell = lambda x: spark.range(1).select(angular.cell_for(F.lit(x)).alias("c")).first().c
    assert [cell(x) for x in (0.0, 350.0, 350.1, 700.0, 1400.5)] == [0.25, 0.25, 0.5, 0.5, 2.0]


def test_cards(spark):
    rows = [(0, "R1", "rare", 2, [5, 6]), (0, "L1", "large", 9, [1, 2, 3])]
    df = spark.createDataFrame(rows, "frame_index long, candidate_id string, kind string, unique_xyz long, members array<long>")
    df = df.withColumns({"branch": F.lit("volume_or_suspended"), **{f"extent_{a}_m": F.lit(1.0) for a in "slh"}, "s_min_m": F.lit(3.0), "h_min_m": F.lit(0.0), "range_from_sensor_m": F.lit(3.5)})
    d = spark.createDataFrame([(0, "candidate_only"), (1, "no_intrusion_detected")], "frame_index long, decision string")
    got = {r.frame_index: r.listed for r in journal.cards(d, df).collect()}
    assert [x.candidate_id for x in got[0]] == ["L1", "R1"] and "members" not in got[0][0] and got[1] is None
