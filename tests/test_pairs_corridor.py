import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.config import SPARSE, Attachment
from pointloom.operators import corridor, pairs, sections
from pointloom.plans import registry

FR = "frame_index long, track int, s_center double, l_median double, h_median double, dh_median double, width_m double, groups long"
STATIONS = (6.0, 10.0, 15.0, 20.0)


def fragments(spark, lines):
    return spark.createDataFrame([(0, t, s, f(s), -0.85, 0.15, 0.07, 8) for t, f in enumerate(lines) for s in STATIONS], FR)


def flat(spark, slope_l=0.0):
    return spark.createDataFrame([(0, s, 0.0, slope_l) for s in STATIONS], "frame_index long, s_center double, slope_s double, slope_l double")


def test_distance_is_across_the_track(spark):
    for yaw in (0.0, math.radians(20)):
        k = math.tan(yaw)
        half = 0.76 / math.cos(yaw)
        p = pairs.pairs(pairs.measure_sections(fragments(spark, [lambda s: 0.45 + k * s - half, lambda s: 0.45 + k * s + half]), flat(spark))).first()
        assert p.distance_m == pytest.approx(1.52, abs=1e-6)


def test_tilted_ground_lengthens_the_distance(spark):
    d = spark.range(1).select(pairs.line_distance(F.lit(0.0), F.lit(1.5), F.lit(0.3), F.lit(0.0), F.lit(0.0), F.lit(0.2)).alias("d")).first().d
    assert d > 1.51


def test_three_lines_share_and_range_limits(spark):
    f = fragments(spark, [lambda s: -0.76, lambda s: 0.76, lambda s: 2.2])
    sec = pairs.measure_sections(f, flat(spark))
    got = {(r.a_track, r.b_track): r.distance_m for r in pairs.pairs(sec).collect()}
    assert set(got) == {(0, 1), (1, 2)}  # 2.96 m is out of range
    res = spark.createDataFrame([(0, 0.05)], "frame_index long, p95_m double")
    ranked = pairs.scores(sec, res, pairs.assumed_sections(f)).collect()
    assert all(r.shared_with == 1 and r.kind == "ambiguous" for r in ranked)  # close rivals are never consistent


def test_consistent_alone_and_converging(spark):
    res = spark.createDataFrame([(0, 0.05)], "frame_index long, p95_m double")
    f = fragments(spark, [lambda s: -0.76, lambda s: 0.76])
    assert pairs.scores(pairs.measure_sections(f, flat(spark)), res, pairs.assumed_sections(f)).first().kind == "consistent"
    g = fragments(spark, [lambda s: -1.0 + 0.03 * s, lambda s: 1.0 - 0.03 * s])
    r = pairs.scores(pairs.agreeing(pairs.measure_sections(g, flat(spark)).drop("usable", "center")).drop("center", "usable", "agree"), res, pairs.assumed_sections(g)).first()
    assert r is None or (r.inconsistent and r.kind == "insufficient")


def test_midpoint_line_and_pose(spark):
    f = fragments(spark, [lambda s: 0.10 + 0.02 * s - 0.75, lambda s: 0.10 + 0.02 * s + 0.75]).where("s_center <> 15")
    keys = ["frame_index", "a_track", "b_track"]
    rows = pairs.agreeing(pairs.measure_sections(f, flat(spark)))
    line = pairs.median_slope_line(rows, keys, "s_center", "mid_l")
    r = line.first()
    assert (r.k, r.b, r.straight) == (pytest.approx(0.02), pytest.approx(0.10), True)
    pose = pairs.pose_at_reference(rows, line, keys).first()
    assert (pose.model_l_m, pose.support, pose.direct_l_m, pose.nearest_s_m) == (pytest.approx(0.40), "gap", None, 10.0)
    near = pairs.pose_at_reference(rows.where("s_center < 15"), line.withColumn("s_max", F.lit(9.0)), keys).first()
    assert (near.support, near.reliable, near.model_l_m, near.reason) == ("extrapolation", False, None, "too_far")


def test_assumed_sections_fill_the_missing_side(spark):
    f = fragments(spark, [lambda s: -0.76, lambda s: 0.76]).where("not (track = 1 and s_center = 10)")
    r = pairs.assumed_sections(f).collect()
    assert [(x.s_center, x.assumed, x.b_l_m) for x in r] == [(10.0, "b", pytest.approx(0.76))]


@pytest.mark.parametrize(("left", "right", "expected"), [
    ((6, 10, 15), (6, 10, 20), []),  # 15 lies past the last station that both have
    ((6, 10, 20), (6, 15, 20), [(10, "b"), (15, "a")]),
    ((6, 10), (10, 15), []),  # one station in common says nothing
    ((10, 15, 20), (6, 10, 20), [(15, "b")]),
])
def test_assumed_sections_lie_between_common_stations(spark, left, right, expected):
    own = {0: left, 1: right}
    f = fragments(spark, [lambda s: -0.76 + 0.01 * s, lambda s: 0.76 + 0.01 * s])
    f = f.where(" or ".join(f"track = {t} and s_center = {s}" for t, at in own.items() for s in at))
    r = pairs.assumed_sections(f).orderBy("s_center").collect()
    assert [(x.s_center, x.assumed) for x in r] == expected
    assert all(x.b_l_m - x.a_l_m == pytest.approx(1.52) for x in r)


KEPT = "frame_index long, s_center double, l_median double, h_median double, dh_median double, width_m double, groups long, fate string"


def asked_of(spark, monkeypatch, places):
    """What the query gives where the clusters (frame, station, l, groups) are these, and the clusters."""
    found = spark.createDataFrame([(f, float(s), float(l), -0.9, 0.1, 0.06, n, "kept") for f, s, l, n in places], KEPT)  # noqa: E741
    monkeypatch.setattr(registry, "_clusters", lambda *_: (None, found))
    return registry.queries()["assumed_sections"](spark, ""), found


def test_assumed_sections_are_asked_of_every_two_lines(spark, monkeypatch):
    """A third line, with fewer points than the one beside it, lacks station 15; it pairs with both of the others."""
    places = [(0, s, l, n) for s in (6, 10, 15, 20, 25) for l, n in ((-0.76, 9), (0.76, 9), (2.2, 5)) if (s, l) != (15, 2.2)]  # noqa: E741
    r = asked_of(spark, monkeypatch, places)[0].orderBy("a_track").collect()
    assert [(x.a_track, x.b_track, x.s_center, x.assumed, x.a_l_m, x.b_l_m) for x in r] == [(0, 2, 15, "b", -0.76, 2.2), (1, 2, 15, "b", 0.76, 2.2)]


@pytest.mark.parametrize(("most", "apart"), [(4, 0.4), (12, 0.2), (45, 0.16)])  # the last has more lines than go on as branches
def test_assumed_sections_of_forks_and_many_lines_equal_their_sql(spark, monkeypatch, most, apart):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(most)
    places = [(f, s, (k + rng.random() / 4 - most / 2) * apart, rng.randint(4, 20)) for f in range(20) for s in (6, 10, 15, 20, 25) for k in range(most) if rng.random() < 0.7]
    got, found = asked_of(spark, monkeypatch, places)
    con = duckdb.connect()
    con.register("cl", found.toArrow())
    sql = registry.oracle_sql()["assumed_sections"].replace(registry._SECTIONS + ",", "")
    want = sorted(con.execute(sql).fetchall())
    assert want and sorted(map(tuple, got.collect())) == want


def test_lines_of_two_stations_pair_but_are_no_candidates(spark):
    """Two stations of two lines: linked with a minimum of two they pair, and the candidates say that they are short."""
    cols = "frame_index long, s_center double, l_median double, h_median double, dh_median double, width_m double, groups long, fate string"
    found = spark.createDataFrame([(0, float(s), l, -0.9, 0.1, 0.06, 9, "kept") for s in (10, 15) for l in (-0.76, 0.76)], cols)  # noqa: E741
    assert sections.link_clusters(found, "robust", SPARSE).count() == 0
    short = sections.link_clusters(found, "robust", SPARSE, 2)
    (pair,) = pairs.pairs(pairs.measure_sections(short, flat(spark))).collect()
    assert (pair.sections, pair.distance_m) == (2, pytest.approx(1.52))
    lines = spark.createDataFrame([(0, k, -1.0, 0.0, -3.0, 3.0) for k in range(13)], LINES)
    told = sections.line_candidates(short, lines, SPARSE).collect()
    assert len(told) == 2 and all(r.below_minimum and r.sections == 2 for r in told)


LINES = "frame_index long, segment int, intercept double, slope_dh_dl double, l_min double, l_max double"


def placed(spark, points, mid=lambda s: 0.0, stations=STATIONS, attachment=None):
    m = spark.createDataFrame([(0, "H1", s, mid(s)) for s in stations], "frame_index long, hypothesis string, s double, l double")
    lines = spark.createDataFrame([(0, k, -1.0, 0.0, -3.0, 3.0) for k in range(13)], LINES)
    v = corridor.vertices(m, lines, attachment).cache()
    p = spark.createDataFrame([(0, k, *map(float, x)) for k, x in enumerate(points)], "frame_index long, point_id long, s double, l double, h double")
    return corridor.classify(p, corridor.segments(v), v).orderBy("point_id").collect()


def test_profile_borders_are_closed(spark):
    r = placed(spark, [(15, 1.05, -0.5), (15, 1.06, -0.5), (15, 2.1, -0.5), (15, 0, -1.0), (15, 0, 2.0), (15, 0, 2.01)])
    assert [x.relation for x in r] == ["inside", "outside", "outside", "inside", "inside", "outside"]


def test_curve_and_gap_and_ends(spark):
    r = placed(spark, [(20, 0.25, -0.5)], mid=lambda s: 0.01 * (s - 15) ** 2)[0]
    assert r.relation == "inside" and r.lateral_m == pytest.approx(0.0, abs=1e-9)
    gap = placed(spark, [(15, 0, -0.5)], stations=(6.0, 10.0, 20.0))[0]
    assert (gap.relation, gap.uncertain_reason) == ("uncertain", "gap_interpolation")
    near, before, far = placed(spark, [(6, 0, -0.5), (5.2, 0, -0.5), (220, 0, -0.5)])
    assert near.relation == "inside"
    assert (before.relation, before.uncertain_reason) == ("uncertain", "extrapolated")
    assert (far.uncertain_reason, far.support, far.lateral_m) == ("outside_applicability", "unsupported", None)
    side = placed(spark, [(10, 1.2, -0.5)])[0]
    assert (side.lateral_m, side.relation) == (pytest.approx(1.2), "outside")


def test_one_section_has_no_direction(spark):
    near, far = placed(spark, [(15.3, 0.2, -0.5), (16, 0.2, -0.5)], stations=(15.0,))
    assert (near.relation, near.uncertain_reason, near.support, near.lateral_m) == ("uncertain", "insufficient_direction", "observed", pytest.approx(0.2))
    assert (far.uncertain_reason, far.support) == ("outside_applicability", "unsupported")


def test_attachment_counts_matches(spark):
    m = spark.createDataFrame([(0, h, s, a) for h, a in (("H1", -1.40), ("H2", 1.26)) for s in (6.0, 10.0)], "frame_index long, hypothesis string, s double, l double")
    at = lambda l, **k: Attachment(6.0, l, 5.0, 12.0, **k)  # noqa: E741, E731
    assert (lambda r: (r.attachment, r.hypotheses))(corridor.attachment_match(m, at(-1.40)).first()) == ("one", ["H1"])
    assert corridor.attachment_match(m, Attachment(6.0, -1.40, 12.0, 20.0)).first().attachment == "none"  # no section in the window
    assert corridor.attachment_match(m, at(-1.40, heading=0.3)).first().attachment == "none"
    one = m.where("s = 6")  # a single section has no heading to compare
    assert corridor.attachment_match(one, at(-1.40, heading=0.3)).first().attachment == "one"
    two = spark.createDataFrame([(0, h, s, a) for h, a in (("H1", -0.40), ("H2", -0.10)) for s in (6.0, 10.0)], "frame_index long, hypothesis string, s double, l double")
    assert corridor.attachment_match(two, at(-0.28)).first().attachment == "several"


def test_overlap(spark):
    q = [corridor.object_overlap(F.lit(0.0), F.lit(0.10), F.lit(f), F.lit(3.0)).alias(f"f{k}") for k, f in enumerate((0.0, 0.05, 0.10, 0.15))]
    assert list(spark.range(1).select(*q).first()) == pytest.approx([0.10, 0.05, 0.0, 0.0])
