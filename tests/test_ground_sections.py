from dataclasses import replace

import numpy as np
import pytest

from pointloom.config import GROUND, SPARSE
from pointloom.operators import ground, sections

PTS = "frame_index long, point_id long, s double, l double, h double"


def cloud(spark, parts):
    rows = [(0, float(s), float(a), float(h)) for p in parts for s, a, h in p]
    return spark.createDataFrame([(f, k, s, a, h) for k, (f, s, a, h) in enumerate(rows)], PTS)


def surfaces():
    r = np.random.default_rng(1)
    make = lambda n, h: np.column_stack([r.uniform(5, 30, n), r.uniform(-3, 3, n), h + r.normal(0, 0.005, n)])
    return [make(2500, -1.0), make(4000, 2.5), make(8, -4.0)]


@pytest.fixture(scope="module")
def fitted(spark):
    df = cloud(spark, surfaces()).cache()
    tracks = ground.link_modes(ground.height_modes(ground.in_region(df))).cache()
    return df, tracks, ground.local_lines(ground.band_rows(df, tracks)).cache()


def test_larger_ceiling_does_not_beat_the_floor(fitted):
    _, tracks, _ = fitted
    rows = tracks.collect()
    assert {r.role for r in rows} == {"ground", "higher_surface"}
    assert all(abs(r.h + 1.0) < 0.05 for r in rows if r.role == "ground")
    assert not any(r.ambiguous for r in rows)


def test_lines_heights_and_plane(fitted):
    df, tracks, lines = fitted
    got = lines.collect()
    assert len(got) >= 12 and all(abs(r.intercept + 1.0) < 0.01 and abs(r.slope_dh_dl) < 0.01 for r in got)
    near = ground.above_ground(df, lines).where("h < 0 and h > -2").agg({"dh": "max"}).first()[0]
    assert near < 0.05
    out = ground.above_ground(cloud(df.sparkSession, [[(40.0, 0.0, -1.0), (30.0, 0.0, -1.0)]]), lines).collect()
    assert [(r.dh, r.supported) for r in out] == [(None, False), (None, False)]  # 30 falls out of every half-open segment
    plane = ground.summary_plane(df.where("h < 0 and h > -2")).first()
    assert plane.tilt_deg < 0.5 and abs(plane.c + 1.0) < 0.02
    assert ground.fitting_residual(ground.band_rows(df, tracks), lines).first().p95_m < 0.03


def test_islands_split_at_gaps_and_reject(spark):
    line = [(6.0, 0.70 + 0.01 * k, -0.8) for k in range(6)]
    few = [(6.0, -1.0 + 0.01 * k, -0.8) for k in range(3)]
    wide = [(6.0, 1.5 + 0.14 * k, -0.8) for k in range(7)]
    floor = [(6.0, -2 + 0.1 * k, -1.0) for k in range(30)]
    rows = cloud(spark, [line, few, wide, floor]).selectExpr("*", "h + 1.0 as dh")
    got = {r.fate: r for r in sections.clusters(sections.section_rows(rows)).where("s_center = 6").collect()}
    assert (got["kept"].groups, got["few"].groups, got["wide"].groups) == (6, 3, 7)
    assert got["kept"].l_median == pytest.approx(0.725)
    lost = sections.rejections(sections.section_rows(rows)).where("s_center = 6").first()
    assert (lost.kept, lost.few, lost.wide, lost.below_band, lost.in_band) == (1, 1, 1, 30, 16)
    roles = {r.role for r in sections.roles(sections.section_rows(rows)).where("s_center = 6").collect()}
    assert roles == {"kept", "rejected_few", "rejected_wide", "below_height_band"}


def test_sections_widen_where_empty(spark):
    rows = cloud(spark, [[(6.8, 0.1 * k, -1.0) for k in range(30)], [(9.6, 0.1 * k, -1.0) for k in range(5)]])
    got = {r.s_center: (r.status, r.expanded) for r in sections.section_rows(rows).select("s_center", "status", "expanded").distinct().collect()}
    assert got == {6.0: ("ok", True), 10.0: ("insufficient", True)}


CL = "frame_index long, s_center double, island long, l_median double, h_median double, dh_median double, width_m double, groups long, fate string"


def clusters(spark, places):
    return spark.createDataFrame([(0, float(s), k, float(a), -0.8, 0.2, 0.06, 10, "kept") for k, (s, a) in enumerate(places)], CL)


@pytest.mark.parametrize("mode", ["fixed_dl", "spatial", "robust"])
def test_straight_lines_link_in_any_order(spark, mode):
    places = [(s, side + 0.01 * s) for s in (6, 10, 15, 20, 25) for side in (-0.76, 0.76)]
    key = lambda df: sorted((r.track, r.s_center, r.l_median) for r in sections.link_clusters(df, mode).collect())
    a = key(clusters(spark, places))
    assert len(a) == 10 and len({t for t, _, _ in a}) == 2
    assert a == key(clusters(spark, places[::-1]))


def test_inclined_line_needs_the_forecast(spark):
    df = clusters(spark, [(s, 0.1 * s) for s in (6, 10, 15, 20, 25)])
    assert {r.sections for r in sections.link_clusters(df, "robust").collect()} == {5}
    assert sections.link_clusters(df, "fixed_dl").count() == 0


def test_one_missed_section_is_bridged_two_are_not(spark):
    assert {(r.sections, r.missed) for r in sections.link_clusters(clusters(spark, [(6, 0), (10, 0), (20, 0), (25, 0)])).collect()} == {(4, 1)}
    assert sections.link_clusters(clusters(spark, [(6, 0), (10, 0), (25, 0)])).count() == 0


def lines_of(spark, places, mode="robust", need=1):
    by = {}
    for r in sections.link_clusters(clusters(spark, places), mode, min_sections=need).collect():
        by.setdefault(r.track, []).append((r.s_center, round(r.l_median, 3)))
    return sorted(sorted(x) for x in by.values())


def test_steep_lines_do_not_start(spark):
    steep = [(6, 0.0), (10, 0.8), (15, 1.8)]  # a slope of 0.2, over the cone of 0.15 and over the match distance
    for mode in ("robust", "spatial", "fixed_dl"):
        assert lines_of(spark, steep, mode) == [[(6.0, 0.0)], [(10.0, 0.8)], [(15.0, 1.8)]]
    assert lines_of(spark, [(6, 0.0), (10, 0.5)]) == [[(6.0, 0.0), (10.0, 0.5)]]  # 0.125 is in the cone
    assert lines_of(spark, [(6, 0.0), (10, 0.5)], "spatial") == [[(6.0, 0.0)], [(10.0, 0.5)]]  # one sample has the match distance only


def test_forecast_starts_at_the_last_sample(spark):
    bent = [(6, 0.0), (10, 0.0), (15, 0.0), (20, 0.24)]
    assert lines_of(spark, bent) == [[(6.0, 0.0), (10.0, 0.0), (15.0, 0.0), (20.0, 0.24)]]
    # slopes of the last four: 0, 0, 0.048, 0.024, 0.017, 0; their median 0.0086 from 0.24 on gives 0.283 at 25
    assert [(25.0, 0.53)] not in lines_of(spark, [*bent, (25, 0.53)]) and [(25.0, 0.54)] in lines_of(spark, [*bent, (25, 0.54)])


def test_close_rivals_branch(spark):
    fork = [(6, 0.0), (10, 0.0), (15, 0.0), (20, 0.04), (20, -0.05)]
    for mode in ("spatial", "robust"):
        assert lines_of(spark, fork, mode) == [[(6.0, 0.0), (10.0, 0.0), (15.0, 0.0), (20.0, -0.05)], [(6.0, 0.0), (10.0, 0.0), (15.0, 0.0), (20.0, 0.04)]]
        others = {r.track: r.alternatives for r in sections.link_clusters(clusters(spark, fork), mode).collect()}
        assert sorted(map(tuple, others.values())) == [(-0.05,), (0.04,)]
    assert len(lines_of(spark, fork, "fixed_dl")) == 2 and [(20.0, -0.05)] in lines_of(spark, fork, "fixed_dl")
    assert len(lines_of(spark, [(6, 0.0), (10, 0.0), (15, 0.0), (20, 0.0), (20, 0.2)])) == 2  # not close enough: a line of its own


def test_branches_take_no_other_lines_cluster(spark):
    two = [(s, side) for s in (6, 10, 15) for side in (0.0, 0.3)] + [(20, 0.12), (20, 0.18)]
    assert lines_of(spark, two) == [[(6.0, 0.0), (10.0, 0.0), (15.0, 0.0), (20.0, 0.12)], [(6.0, 0.3), (10.0, 0.3), (15.0, 0.3), (20.0, 0.18)]]


def test_line_candidates(spark):
    frag = sections.link_clusters(clusters(spark, [(6, 0.0), (10, 0.01), (20, 0.02)]))
    ground_lines = spark.createDataFrame([(0, 0, -1.0, 1.0), (0, 2, 0.5, 1.0)], "frame_index long, segment int, l_min double, l_max double")
    c = sections.line_candidates(frag, ground_lines).first()
    assert (c.geometry_key, c.gaps_s_m, c.sections, c.below_minimum, c.groups) == ("6.0:0.000|10.0:0.010|20.0:0.020", [15.0], 3, False, 30)
    assert [x.height_support for x in c.samples] == ["supported", "extrapolated", "unknown"] and c.l_median_m == 0.01
    f = sections.selection_funnel(clusters(spark, [(6, 0.0), (10, 0.0), (15, 0.0), (15, 0.7)])).first()
    assert (f.kept, f.robust_lines, f.robust_candidates, f.fixed_dl_candidates) == (4, 2, 2, 1)  # of a young line every continuation in the cone is one


def test_broken_hops(spark):
    def hop(places):
        return sections.broken_hops(spark.createDataFrame([(0, 0, float(s), float(a)) for s, a in places], "frame_index long, track int, s_center double, l_median double")).first()

    assert not hop([(6, 0.0), (10, 0.2), (15, 0.45)]).broke
    r = hop([(6, 0.0), (10, 0.2), (15, 0.0)])  # the two samples before forecast 0.45
    assert (r.broke, r.at_s_m, r.from_s_m, r.mode, r.expected_l_m, r.residual_m) == (True, 15.0, 10.0, "last_two_samples", pytest.approx(0.45), pytest.approx(0.45))
    first = hop([(6, 0.0), (10, 0.4), (15, 9.0)])
    assert (first.at_s_m, first.mode, first.slope_dl_ds) == (10.0, "no_slope_yet", None)


def wide(s, step=0.1, right=10):
    """An island 0.64 m wide with two inner peaks, rows of one height under each."""
    thin = [(s, 0.04 + 0.08 * k, -0.8 + (step if k > 4 else 0.0)) for k in range(9)]
    return thin + [(s, 0.13 + 0.005 * k, -0.8) for k in range(10)] + [(s, 0.53 + 0.005 * k, -0.8 + step) for k in range(right)]


def test_wide_islands_split_where_both_parts_go_on(spark):
    def profiles(*parts):
        rows = sections.section_rows(cloud(spark, [*parts, *[[(s, -2 + 0.05 * k, -1.0) for k in range(30)] for s in (6.0, 10.0)]]).selectExpr("*", "h + 1.0 as dh"))
        return {r.s_center: r for r in sections.wide_profile(rows).collect()}

    both = profiles(wide(6.0), wide(10.0))
    assert both[6.0].splits and both[6.0].valley == 1 and both[6.0].dh_step_m == pytest.approx(0.1) and both[6.0].part_groups == [15, 14]
    assert (both[10.0].splits, both[10.0].reason) == (False, "seen_at_one_station_only")
    assert profiles(wide(6.0, 0.01), wide(10.0))[6.0].reason == "valley_or_height_step_too_small"
    moved = [(s, l + 2.5, h) for s, l, h in wide(10.0)]
    assert profiles(wide(6.0), moved)[6.0].reason == "does_not_go_on"


def test_sparse_thresholds_only_change_counts():
    assert (SPARSE.min_groups_per_mode, SPARSE.section_min_groups, SPARSE.structure_min_groups) == (12, 8, 4)
    assert SPARSE.height_bin_m == GROUND.height_bin_m


def test_summary_plane_of_all_triples_at_once_is_that_of_one_after_the_other(spark):
    r = np.random.default_rng(3)
    s, l = r.uniform(5, 30, 60), r.uniform(-3, 3, 60)  # noqa: E741
    h = np.where(np.arange(60) < 45, -1 + 0.01 * s + 0.02 * l, r.uniform(0, 2, 60))
    pts = spark.createDataFrame([(1, *map(float, x)) for x in zip(s, l, h)], "frame_index long, s double, l double, h double")
    p = ground.summary_plane(pts).first()
    assert abs(p.b_s - 0.01) < 1e-9 and abs(p.b_l - 0.02) < 1e-9 and abs(p.c + 1) < 1e-9 and (p.inliers, p.groups) == (45, 60)
    assert ground.summary_plane(pts.limit(29)).count() == 0


@pytest.mark.parametrize("name", ["side_funnel", "corridor_vertices", "pair_kinds", "owned_decisions"])
def test_a_query_builds_the_ground_once(spark, monkeypatch, name):
    """The cloud and its ground, with all their passes over the points, are not made again for each use in a query."""
    from pointloom.plans import library, registry

    calls, surface = [], registry.surface
    for module in (registry, library):
        monkeypatch.setattr(module, "surface", lambda *a, **k: calls.append(1) or surface(*a, **k))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_lines_and_their_frames_residual_come_in_one_pass(spark):
    r = np.random.default_rng(4)
    rows = [(f, float(s), float(l), -1 + 0.02 * float(l) + float(e)) for f in (0, 1) for s, l, e in zip(r.uniform(5, 30, 700), r.uniform(-3, 3, 700), r.normal(0, 0.01, 700))]
    df = spark.createDataFrame(rows, "frame_index long, s double, l double, h double")
    band = ground.band_rows(df, ground.link_modes(ground.height_modes(df, SPARSE), SPARSE), SPARSE).cache()
    got = ground.lines_and_residual(band)
    pooled = ["frame_p50_m", "frame_p95_m", "frame_groups"]
    key = lambda d: sorted(tuple(x) for x in d.collect())
    assert key(got.drop(*pooled)) == key(ground.local_lines(band)) and got.count() == 26
    assert key(got.select("frame_index", *pooled).distinct()) == key(ground.fitting_residual(band))
