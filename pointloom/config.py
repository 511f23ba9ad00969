"""Numbers of the geometry and the rule. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Ground:
    s_min_m: float = 5.0
    s_max_m: float = 30.0
    segment_m: float = 2.0
    height_bin_m: float = 0.05
    min_groups_per_mode: int = 40
    min_lateral_span_m: float = 1.5
    continuity_m: float = 0.30
    plane_inlier_m: float = 0.08
    section_s_m: tuple[float, ...] = (6.0, 10.0, 15.0, 20.0, 25.0)
    section_half_m: float = 0.5
    section_half_fallback_m: float = 1.0
    section_min_groups: int = 30
    structure_dh_min_m: float = 0.04
    structure_dh_max_m: float = 0.40
    structure_l_gap_m: float = 0.15
    structure_max_width_m: float = 0.60
    structure_min_groups: int = 6
    structure_min_sections: int = 3
    structure_match_m: float = 0.25
    structure_max_missed_sections: int = 1
    structure_link_ambiguity_m: float = 0.10
    wide_bin_m: float = 0.08
    wide_valley_ratio: float = 0.40
    wide_peak_dh_m: float = 0.05
    wide_peak_gap_m: float = 0.12
    init_max_abs_dl_ds: float = 0.15
    forecast_min_sections: int = 3
    forecast_window: int = 4
    max_alternatives: int = 3
    max_live_tracks: int = 32


@dataclass(frozen=True)
class Pairs:
    min_distance_m: float = 0.40
    max_distance_m: float = 2.80
    agree_m: float = 0.25
    min_sections: int = 2
    slope_difference: float = 0.02
    distance_span_m: float = 0.25
    direction_scale: float = 0.08
    height_floor_m: float = 0.05
    wide_m: float = 0.60
    wide_score: float = 0.4
    weak_score: float = 0.35
    strong_score: float = 0.6
    rival_score: float = 0.15
    straight_p95_m: float = 0.08
    reference_s_m: float = 15.0
    extrapolate_m: float = 5.0
    admit_m: float = 0.12
    admit_after: int = 3
    conflict_run: int = 3
    width_window: int = 9
    pose_window: int = 3
    match_m: float = 0.40
    match_gap_m: float = 0.15


@dataclass(frozen=True)
class Detector:
    object_height_m: float = 0.10
    object_fraction: float = 0.5
    line_height_tol_m: float = 0.05
    line_half_m: float = 0.5
    line_width_m: float = 0.20
    cell_gap_m: float = 0.15
    link_m: float = 0.15
    far_link_m: float = 0.23
    far_range_m: float = 70.0
    large_min: int = 8
    radii_m: tuple[float, ...] = (0.5, 1.0, 2.0)
    anchor_step_m: float = 0.5
    min_support: int = 12
    lower_fraction: float = 0.40
    level_gap_m: float = 0.08
    unstable_ratio: float = 2.0
    fit_min: int = 8
    holdout_min: int = 4
    #: Slope of a plane at most (30 degrees), random triples and their seed.
    steepest: float = 0.57735026919
    tries: int = 40
    seed: int = 4


@dataclass(frozen=True)
class Profile:
    width_m: float = 2.1
    height_m: float = 3.0
    center_l_m: float = 0.0
    s_min_m: float = 1.0
    s_max_m: float = 120.0
    far_from_m: float = 25.0
    rail_head_h_m: float = -1.075
    floor_offset_m: float = 0.0

    @property
    def floor_h_m(self) -> float:
        return self.rail_head_h_m + self.floor_offset_m


@dataclass(frozen=True)
class Rule:
    min_points: int = 8
    min_height_m: float = 0.10
    face_height_m: float = 0.30
    thin_extent_m: float = 0.80
    thin_points: int = 10
    thin_clearance_m: float = 1.0
    sheet_height_m: float = 0.05
    sheet_width_m: float = 1.50
    slack: float = 1e-9


@dataclass(frozen=True)
class Axis:
    heading: float = 0.15
    min_span_m: float = 4.0


@dataclass(frozen=True)
class Attachment:
    """Where a session was attached to a track, and how far a hypothesis may be from it."""

    s_m: float
    l_m: float
    support_s_min_m: float
    support_s_max_m: float
    lateral_m: float = 0.25
    heading: float | None = None
    heading_tolerance: float | None = 0.15


GROUND, PAIRS, DETECTOR, PROFILE, RULE, AXIS = Ground(), Pairs(), Detector(), Profile(), Rule(), Axis()
#: Thresholds for sparse clouds of some hundred points a frame.
SPARSE = replace(GROUND, min_groups_per_mode=12, section_min_groups=8, structure_min_groups=4)
