import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.config import DETECTOR
from pointloom.operators import detect, evaluate, rule, spatial

PT = "frame_index long, point_id long, s double, l double, h double, radius double"


def pts(spark, xyz, radius=0.15, frame=0):
    return spark.createDataFrame([(frame, k, *map(float, p), float(radius)) for k, p in enumerate(xyz)], PT)


def brute(xyz, radius):
    n, label = len(xyz), list(range(len(xyz)))
    a = np.array(xyz)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            near = ((a - a[i]) ** 2).sum(1) <= radius**2
            low = min(label[j] for j in np.flatnonzero(near))
            for j in np.flatnonzero(near):
                if label[j] != low:
                    label[j], moved = low, True
    return label


def test_cells_over_the_table_equal_the_kernel(spark):
    """Dense, sparse and far frames with two radii: the joined form gives the labels of the kernel."""
    r = np.random.default_rng(8)
    rows = []
    for f, (n, size) in enumerate(((400, 1.0), (600, 3.0), (300, 0.2), (1, 1.0), (250, 2.0))):
        xyz = r.uniform(-size, size, (n, 3)) + (0 if f != 4 else 58)
        rows += [(f, k, *map(float, x)) for k, x in enumerate(xyz)]
    # a chain whose links lie exactly on the border, and two dense cells that only their outermost points link
    rows += [(5, k, 0.15 * k, 0.0, 0.0) for k in range(8)] + [(6, k, float(x), 0.0, 0.0) for k, x in enumerate([*np.linspace(0, 0.05, 40), *np.linspace(0.19, 0.24, 40)])]
    df = spark.createDataFrame(rows, "frame_index long, point_id long, s double, l double, h double").withColumn("radius", spatial.link_radius())
    key = lambda x: sorted((p.frame_index, p.point_id, p.label) for p in x.collect())
    one = key(spatial.components(df))
    assert key(spatial.components(df, by_frame=False)) == one and len({(f, c) for f, _, c in one}) > 20
    assert spatial.components(df.where("false"), by_frame=False).count() == 0


def test_a_dense_cell_is_one_node(spark):
    """A million places in a few cells: no pair of points of a cell is ever joined."""
    dense = spark.range(1_000_000).select(F.lit(0).cast("long").alias("frame_index"), F.col("id").alias("point_id"), ((F.col("id") % 1000) * 1e-5).alias("s"),
        (F.floor(F.col("id") / 1000) * 1e-5).alias("l"), F.when(F.col("id") < 500_000, 0.0).otherwise(5.0).alias("h"), F.lit(0.15).alias("radius"))
    got = {(r.label, r["count"]) for r in spatial.components(dense, by_frame=False).groupBy("label").count().collect()}
    assert got == {(0, 500_000), (500_000, 500_000)}


@pytest.mark.parametrize("by_frame", [True, False])
def test_components_equal_brute_force(spark, by_frame):
    r = np.random.default_rng(4)
    xyz = r.uniform(0, 0.8, (48, 3)).tolist()
    xyz += [xyz[0], (3.0, 0.0, 0.0), (3.15, 0.0, 0.0)]
    got = spatial.components(pts(spark, xyz, 0.1500001), 0.1500001, by_frame).orderBy("point_id").collect()
    assert [x.label for x in got] == brute(xyz, 0.1500001)


def test_distance_and_cells_differ(spark):
    two = [(0.01, 0, 0), (0.29, 0, 0)]  # neighbouring cells, 0.28 apart
    assert {r.label for r in spatial.cell_components(pts(spark, two)).collect()} == {0}
    assert {r.label for r in spatial.components(pts(spark, two)).collect()} == {0, 1}


def test_chain_links_and_sparse_does_not(spark):
    assert {r.label for r in spatial.components(pts(spark, [(0.14 * k, 0, 0) for k in range(3)])).collect()} == {0}
    assert len({r.label for r in spatial.components(pts(spark, [(0.40 * k, 0, 0) for k in range(3)])).collect()}) == 3


def test_far_returns_link_wider(spark):
    df = pts(spark, [(80.0, 0, 0), (80.2, 0, 0), (10.0, 0, 0), (10.2, 0, 0)]).withColumn("radius", spatial.link_radius())
    for by_frame in (True, False):
        assert [r.label for r in spatial.components(df, 0.23, by_frame).orderBy("point_id").collect()] == [0, 0, 2, 3]


def test_line_masks_need_height_support(spark):
    p = pts(spark, [(6, 0.76, -0.85), (6, 0.76, -0.60), (6, -0.76, -0.60), (6, 0, 0)])
    s = spark.createDataFrame([(0, 6.0, 0.76, -0.85, 0.2, True), (0, 6.0, -0.76, None, 0.2, False)], "frame_index long, s_center double, l_median double, h_median double, width_m double, supported boolean")
    got = [(r.excluded, r.possible) for r in detect.line_masks(p, s).orderBy("point_id").collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False)]


@pytest.mark.parametrize(("band", "mode", "explained", "ambiguous"), [(None, "no_fitting_residual", 0, 0), (0.02, "thin_band_removed", 2, 0), (0.06, "ambiguous_not_deleted", 0, 3)])
def test_surface_modes(spark, band, mode, explained, ambiguous):
    p = spark.createDataFrame([(0, k, d, -1.0 + d, True, True) for k, d in enumerate((0.0, 0.02, 0.08, 0.3, -0.01))], "frame_index long, point_id long, dh double, h double, inside boolean, supported boolean")
    res = spark.createDataFrame([(0, band)], "frame_index long, p95_m double")
    got = detect.surface_masks(p, res).collect()
    assert {r.surface_mode for r in got} == {mode}
    assert (sum(r.explained for r in got), sum(r.ambiguous for r in got)) == (explained, ambiguous)


def test_local_bump_is_accepted_and_two_levels_refused(spark):
    r = np.random.default_rng(3)
    flat = [(0.02 * k, 0.0, float(h)) for k, h in enumerate(r.uniform(0, 0.004, 60))]
    bump = [(0.3 + 0.05 * k, 0.0, 0.04) for k in range(6)]
    all_ = pts(spark, flat + bump)
    got = detect.local_protrusions(all_.where("h > 0.02"), all_).collect()
    assert len(got) == 6 and all(r.accepted for r in got)
    two = pts(spark, [(0.05 * k, 0.0, 0.0) for k in range(15)] + [(0.05 * k, 0.01, 0.30) for k in range(15)])
    refused = detect.local_protrusions(two.where("h > 0.2"), two).collect()
    assert {r.reason for r in refused} == {"several_levels"} and not any(r.accepted for r in refused)


C = "frame_index long, candidate_id string, branch string, unique_xyz long, extent_s_m double, extent_l_m double, extent_h_m double, s_min_m double, h_min_m double, range_from_sensor_m double"


@pytest.mark.parametrize(
    ("n", "size", "s_min", "h_min", "branch", "evidence", "reason"),
    [
        (483, (0.012, 1.904, 1.443), 33.0, -0.5, "volume_or_suspended", "volume", None),
        (16, (0.01, 0.26, 1.50), 98.0, -0.5, "volume_or_suspended", "vertical_face", None),
        (10, (1.20, 0.02, 0.02), 10.0, 0.5, "volume_or_suspended", "thin_fragment", None),
        (10, (1.20, 0.02, 0.02), 10.0, -0.9, "volume_or_suspended", None, "extent_below_object_size"),
        (20, (0.055, 1.946, 0.0017), 10.0, 0.5, "volume_or_suspended", None, "wide_flat_sheet_not_a_fragment"),
        (1, (0.0, 0.0, 0.0), 10.0, 0.5, "volume_or_suspended", None, "single_point_is_weak"),
        (5, (0.4, 0.4, 0.4), 10.0, 0.5, "volume_or_suspended", None, "support_below_large_min"),
        (9, (0.3, 0.1, 0.1), 10.0, 0.5, "local_protrusion", "low_protrusion", None),
        (9, (0.1, 0.1, 0.05), 10.0, 0.5, "local_protrusion", None, "low_protrusion_seen_not_accepted"),
        (9, (0.3, 0.3, 0.3), 10.0, 0.5, "surface", None, "not_an_unexplained_volume_cluster"),
        (9, (None, None, None), None, None, "volume_or_suspended", None, "extent_below_object_size"),
    ],
)
def test_rule_table(spark, n, size, s_min, h_min, branch, evidence, reason):
    r = rule.with_evidence(spark.createDataFrame([(0, "L1", branch, n, *size, s_min, h_min, 33.05)], C)).first()
    assert (r.evidence, r.reason) == (evidence, reason)
    assert r.corridor_segment == ("position_unknown" if s_min is None else "assumed_continuation" if s_min >= 25 else "near_straight_assumption")


def test_decisions_and_gates(spark):
    rows = [(0, "ok", "configured_straight", True, True), (1, "ok", "configured_straight", True, True), (2, "ok", "configured_straight", True, True), (3, "processing_timeout", "configured_straight", True, True), (4, "insufficient_geometry", "configured_straight", True, False), (5, "ok", "inferred", True, True), (6, "ok", "configured_straight", False, True), (7, "ok", "configured_straight", True, False)]
    frames = spark.createDataFrame(rows, "frame_index long, status string, corridor_source string, profile_applicable boolean, ground_found boolean")
    judged = rule.with_evidence(spark.createDataFrame([(f, "L1", "volume_or_suspended", n, 0.4, 0.4, 0.4, 10.0, 0.5, 12.0) for f, n in ((0, 20), (1, 1), (7, 20))], C))
    got = {r.frame_index: (r.decision, r.intrusions) for r in rule.decide(frames, judged).collect()}
    assert got == {0: ("conditional_intrusion", 1), 1: ("candidate_only", 0), 2: ("no_intrusion_detected", 0), 3: ("processing_timeout", 0), 4: ("insufficient_geometry", 0), 5: ("insufficient_evidence", 0), 6: ("insufficient_evidence", 0), 7: ("insufficient_evidence", 0)}


def test_candidates_and_insertion(spark):
    r = np.random.default_rng(4)
    box = r.uniform((10, 0, 0), (10.3, 0.3, 0.1), (48, 3)).tolist()
    df = pts(spark, box + [(20.0, 0, 0)]).withColumn("range_m", F.sqrt(F.col("s") ** 2 + F.col("l") ** 2 + F.col("h") ** 2))
    c = detect.candidates(spatial.components(df)).cache()
    assert sorted((x.candidate_id, x.unique_xyz) for x in c.collect()) == [("L1", 48), ("R1", 1)]


def outcome(spark, cands, inserted, inside=(), layer=(), lines=(), prior=None):
    n = 12
    marks = spark.createDataFrame([(0, k, k in inside, k in lines, False, k in layer) for k in range(n)], "frame_index long, point_id long, inside boolean, excluded boolean, explained boolean, ambiguous boolean")
    c = "frame_index long, candidate_id string, unique_xyz long, range_from_sensor_m double, members array<long>"
    found = spark.createDataFrame([(0, f"L{k}", len(m), 10.0, list(m)) for k, m in enumerate(cands)], c)
    before = None if prior is None else spark.createDataFrame([(0, "old", len(m), 10.0, list(m)) for m in prior], c)
    ins = spark.createDataFrame([(0, k, 10.0 + k) for k in inserted], "frame_index long, point_id long, range_m double")
    return evaluate.insertion(marks, found, ins, before).first()


def test_insertion_outcomes(spark):
    every = range(12)
    assert outcome(spark, [], [1, 2]).outcome == "outside_corridor"
    r = outcome(spark, [[1, 2, 3]], [1, 2, 4], every)
    assert (r.outcome, r.hits, r.pieces, r.share, r.range_error_m) == ("predominantly_insertion", 2, 1, pytest.approx(2 / 3), pytest.approx(1.0))
    assert outcome(spark, [[1, 2]], [1], every).outcome == "merged_with_background"  # half is no majority
    assert outcome(spark, [[1, 5, 6]], [1], every).outcome == "merged_with_background"
    assert outcome(spark, [[1, 2, 5]], [1, 2], every, prior=[[5]]).outcome == "predominantly_insertion"
    assert outcome(spark, [[5, 6]], [1], every, layer=[1]).outcome == "ambiguous_layer_only"
    assert outcome(spark, [], [1], every, lines=[1]).outcome == "excluded_by_path_volume"
    assert outcome(spark, [], [1], every).outcome == "no_candidate"


def test_candidate_comparison_by_place(spark):
    c = "frame_index long, place int, hypothesis string, candidate_id string, kind string, branch string, members array<long>, range_from_sensor_m double"
    row = lambda f, p, m, r: (f, p, "H", f"L{p}", "large", "volume_or_suspended", m, r)
    a = spark.createDataFrame([row(0, 0, [1, 2], 5.0), row(1, 0, [1], 5.0), row(2, 0, [1], 5.0), row(3, 0, [1], 5.0), row(3, 1, [2], 5.0), row(4, 0, [1], None)], c)
    b = spark.createDataFrame([row(0, 0, [2, 1], 5.000001), row(1, 0, [2], 9.0), row(2, 0, [1], 5.1), row(3, 0, [9], 5.0), row(4, 0, [1], float("nan"))], c)
    assert sorted((r.frame_index, r.difference, r.place) for r in evaluate.compare_candidates(a, b).collect()) == [(1, "members", 0), (2, "range", 0), (3, "number", 1), (4, "range_not_finite", 0)]


def test_faces(spark):
    r = np.random.default_rng(8)
    face = r.uniform((12.0, -0.9, -0.9), (12.2, 0.9, 0.9), (200, 3)).tolist()
    got = evaluate.faces(pts(spark, face + [(20.0, 0, 0)]), min_l_m=1.0, min_h_m=0.5).first()
    assert (got.s_lo_m, got.reason) == (12.0, "separated") and -0.9 <= got.l_p4 < -0.7 < 0.7 < got.l_p96 <= 0.9
    low = [(12.0 + 0.001 * k, -0.9 + 0.009 * k, -0.9) for k in range(200)]
    assert evaluate.faces(pts(spark, low)).first().reason == "not_apart_from_the_floor"
    assert evaluate.faces(pts(spark, [(12.0, -2.0 + 0.02 * k, 0.01 * k) for k in range(200)])).first().reason == "spans_the_tunnel"
    assert evaluate.faces(pts(spark, face), F.col("s") < 12.0).count() == 0


def test_pick_frames_knows_three_failures(spark):
    f = spark.createDataFrame([(0, "ok", 3), (1, "processing_timeout", 9), (2, "processing_timeout", 9), (3, "processing_timeout", 0), (5, "no_hypotheses", 0), (6, "error", 0), (7, "error", 0), (8, "no_hypotheses", 0)], "frame_index long, status string, candidates int")
    assert {r.why: (r.frame_index, r.n) for r in evaluate.pick_frames(f).collect()} == {"most_candidates": (1, 9), "commonest_failure": (5, 2)}


def test_ransac_and_context(spark):
    r = np.random.default_rng(5)
    floor = [(float(s), float(v), 0.05 * float(s)) for s, v in r.uniform(-0.4, 0.4, (60, 2))]
    bump = [(0.0, 0.02 * k, 0.30) for k in range(6)]
    every = pts(spark, floor + bump)
    got = detect.local_protrusions(every.where("h > 0.2"), every, "ransac").collect()
    assert len(got) == 6 and all(x.accepted and x.threshold_m < 0.08 for x in got)
    alone = detect.local_protrusions(every.where("h > 0.2"), every.where("h > 0.2")).collect()
    assert {x.reason for x in alone} == {"too_few_points"}
    helped = detect.local_protrusions(every.where("h > 0.2"), every.where("h > 0.2"), "ransac", context=pts(spark, floor)).collect()
    assert all(x.accepted for x in helped)  # other scans may support the plane
    two = np.concatenate([np.column_stack([r.uniform(-0.4, 0.4, (40, 2)), np.zeros(40)]), np.column_stack([r.uniform(-0.4, 0.4, (30, 2)), np.full(30, 0.5)])])
    assert detect.local_model(two, "ransac").reason == "several_supports" and detect.local_model(two).reason == "several_levels"
    assert detect.local_model(np.column_stack([np.linspace(0, 1, 40), np.zeros(40), np.zeros(40)]), "ransac").reason in ("narrow_line", "no_plane")


def test_protrusions_join_the_candidates(spark):
    r = np.random.default_rng(6)
    floor = [(10 + float(s), float(v), float(h)) for s, v, h in np.column_stack([r.uniform(-1, 1, (400, 2)), r.uniform(0, 0.004, 400)])]
    bump = [(10 + 0.05 * k, 0.0, 0.09) for k in range(9)]
    box = [(10 + 0.1 * k, 0.1 * j, 0.6 + 0.1 * i) for k in range(3) for j in range(3) for i in range(3)]
    rows = pts(spark, floor + bump + box).withColumns({"range_m": F.sqrt(F.col("s") ** 2), "inside": F.lit(True), "excluded": F.lit(False), "explained": F.lit(False), "ambiguous": F.col("h") < 0.1}).drop("radius")
    got = {x.candidate_id: (x.branch, x.unique_xyz) for x in detect.straight_candidates(rows).collect()}
    assert got["L1"] == ("volume_or_suspended", 27) and got["P1"][0] == "local_protrusion" and got["P1"][1] >= 9
    assert {x.candidate_id for x in detect.straight_candidates(rows, protrusions=False, by_distance=False).collect()} == {"L1"}
    judged = rule.with_evidence(detect.straight_candidates(rows)).where("candidate_id = 'P1'").first()
    assert judged.evidence is None or judged.evidence == "low_protrusion"


def test_volume_is_closed(spark):
    p = pts(spark, [(1, 1.05, -1.075), (120, -1.05, 1.925), (0.99, 0, 0), (5, 1.051, 0), (5, 0, 1.9251)])
    assert sorted(r.point_id for r in detect.configured_volume(p).collect()) == [0, 1]


def test_dominant_model_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(0, 0, m) for m in (5, 5, 3, 3, 9)], "frame_index long, label long, model_id int")
    assert detect.dominant_model(df).first().model_id == 3


def test_links_radius_constant():
    assert DETECTOR.link_m == 0.15 and DETECTOR.far_link_m == 0.23


def test_quantile_of_a_few_values_is_that_of_numpy():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 41):
        a = r.normal(size=n)
        assert all(detect._quantile(a, q) == float(np.quantile(a, q)) for q in (0.0, 0.25, 0.35, 0.5, 0.95, 1.0))


def test_few_points_are_labelled_as_by_cells(monkeypatch):
    r = np.random.default_rng(8)
    xyz = r.uniform(0, 1.2, (200, 3))
    radius = np.where(r.random(200) < 0.2, 0.23, 0.15)
    few = spatial._labels(xyz, radius)
    monkeypatch.setattr(spatial, "FEW_POINTS", 0)
    assert len(set(few.tolist())) > 5 and (few == spatial._labels(xyz, radius)).all()


@pytest.mark.parametrize("fit", ["baseline", "span_limit"])
def test_planes_of_many_places_are_those_of_each(fit):
    r = np.random.default_rng(9)
    a = np.column_stack([np.round(r.uniform(0, 6, 400), 1), r.uniform(-2, 2, 400), 0.001 * r.integers(0, 9, 400) + np.where(r.random(400) < 0.3, 0.3, 0.0)])
    support, at = detect.Support(a, DETECTOR.anchor_step_m), np.column_stack([r.uniform(-1, 7, 40), r.uniform(-2, 2, 40)])
    for radius in DETECTOR.radii_m:
        got = detect._models(support, at, radius, fit, DETECTOR)
        assert got == [detect.local_model(support.around(x, radius), fit) for x in at]
    assert {m.reason for radius in DETECTOR.radii_m for m in detect._models(support, at, radius, fit, DETECTOR)} >= {"too_few_points", "several_levels"}


def test_masks_of_points_are_not_written_out(spark, monkeypatch):
    """Only what is inside and unexplained is stored before candidates are made, once and with the columns that they need."""
    from pointloom.plans import registry

    stored, keyed = [], detect.frame_keyed
    for module in (registry, detect):
        monkeypatch.setattr(module, "frame_keyed", lambda df, *a, **k: stored.append(out := keyed(df, *a, **k)) or out)
    registry.queries()["frame_decisions"](spark, "/root/testdata/sf0.001")
    assert len(stored) == 2 and stored[1].count() < stored[0].count() / 2
    assert set(stored[1].columns) == {"frame_index", "point_id", "s", "l", "h", "range_m", "ambiguous"}
