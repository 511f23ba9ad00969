"""The intrusion rule: evidence for each candidate, one decision for each frame. Nothing is ever called clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AXIS, PROFILE, RULE, Axis, Profile, Rule


def with_evidence(candidates: DataFrame, floor_h_m: float | None = PROFILE.floor_h_m, rule: Rule = RULE, profile: Profile = PROFILE) -> DataFrame:
    """``evidence`` (null: not accepted), ``reason`` of a refusal and the ``corridor_segment``."""
    at_least = lambda c, x: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) + rule.slack >= x
    n = F.coalesce(F.col("unique_xyz"), F.lit(0))
    long_side = F.greatest(F.coalesce("extent_s_m", F.lit(0.0)), F.coalesce("extent_l_m", F.lit(0.0)))
    horizontal = at_least("extent_s_m", rule.face_height_m) | at_least("extent_l_m", rule.face_height_m)
    tall, high = at_least("extent_h_m", rule.face_height_m), at_least("extent_h_m", rule.min_height_m)
    sheet = ~at_least("extent_h_m", rule.sheet_height_m) & at_least("extent_l_m", rule.sheet_width_m)
    elevated = F.lit(True) if floor_h_m is None else F.coalesce(F.col("h_min_m") + rule.slack >= floor_h_m + rule.thin_clearance_m, F.lit(False))
    thin = at_least(long_side, rule.thin_extent_m) & (n >= rule.thin_points) & elevated & ~sheet
    bump, volume, enough = F.col("branch") == "local_protrusion", F.col("branch") == "volume_or_suspended", n >= rule.min_points
    known = F.coalesce(bump | volume, F.lit(False))
    evidence = (
        F.when((n <= 1) | ~known, None)
        .when(bump & enough & high & (horizontal | tall), "low_protrusion")
        .when(volume & enough & high & horizontal, "volume")
        .when(volume & enough & tall, "vertical_face")
        .when(volume & thin, "thin_fragment")
    )
    reason = (
        F.when(n <= 1, "single_point_is_weak")
        .when(~known, "not_an_unexplained_volume_cluster")
        .when(F.col("evidence").isNotNull(), None)
        .when(bump, "low_protrusion_seen_not_accepted")
        .when(sheet & (n >= rule.thin_points) & at_least(long_side, rule.thin_extent_m), "wide_flat_sheet_not_a_fragment")
        .when((n < rule.min_points) & ~thin, "support_below_large_min")
        .otherwise("extent_below_object_size")
    )
    segment = F.when(F.col("s_min_m").isNull(), "position_unknown").when(F.col("s_min_m") >= profile.far_from_m,
        "assumed_continuation").otherwise("near_straight_assumption")
    return candidates.withColumn("evidence", evidence).withColumns({"reason": reason, "corridor_segment": segment})


def gate(status: Column, source: Column, applicable: Column, has_ground: Column) -> Column:
    """The decision and its reason that stand before any candidate is looked at; null where the rule applies."""
    said = lambda decision, reason: F.struct(decision.alias("decision") if isinstance(decision,
            Column) else F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    return (
        F.when(status.isin("processing_timeout", "processing_error"), said(status, "frame_not_finished"))
        .when(status == "insufficient_geometry", said(status, "ground_not_built"))
        .when(source != "configured_straight", said("insufficient_evidence", "no_explicit_profile"))
        .when(~applicable, said("insufficient_evidence", "profile_not_applicable"))
        .when(~has_ground, said("insufficient_evidence", "no_ground_filter"))
    )


def decide(frames: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each frame of ``frames`` (frame_index, status, corridor_source, profile_applicable, ground_found)."""
    seen = judged.groupBy("frame_index").agg(F.count("*").alias("candidates"), F.count("evidence").alias("intrusions"),
        F.min(F.when(F.col("evidence").isNotNull(), F.col("range_from_sensor_m"))).alias("nearest_intrusion_m"))
    out = frames.join(seen, "frame_index", "left").fillna(0, ["candidates", "intrusions"])
    before = gate(F.col("status"), F.col("corridor_source"), F.coalesce("profile_applicable", F.lit(True)), F.col("ground_found"))
    after = (
        F.when(F.col("intrusions") > 0, F.struct(F.lit("conditional_intrusion").alias("decision"),
                F.lit("unexplained_cluster_in_the_volume").alias("reason")))
        .when(F.col("candidates") > 0, F.struct(F.lit("candidate_only").alias("decision"), F.lit("no_candidate_accepted").alias("reason")))
        .otherwise(F.struct(F.lit("no_intrusion_detected").alias("decision"), F.lit("nothing_in_the_volume").alias("reason")))
    )
    out = out.withColumns({"said": F.coalesce(before, after), "applies": before.isNull()})
    out = out.withColumns({"decision": F.col("said.decision"), "reason": F.col("said.reason"),
        "intrusions": F.when(F.col("applies"), F.col("intrusions")).otherwise(0),
        "nearest_intrusion_m": F.when(F.col("applies"), F.col("nearest_intrusion_m"))})
    return out.withColumn("absence_is_not_clear", F.lit(True)).drop("said", "applies")


def axis_assessment(sections: DataFrame, scored: DataFrame, own: DataFrame | None = None, cfg: Axis = AXIS, profile: Profile = PROFILE) -> DataFrame:
    """The midpoint line of each pair of lines against the straight axis.

    A constant offset, a constant heading and a change of heading between the two halves of the support are
    different things. Only the last forbids the straight profile, and only for a strong pair that shares no line, is not
    offset, and is known to be the own track (``own``: frame_index, a_track, b_track).
    """
    keys = ["frame_index", "a_track", "b_track"]
    rows = sections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s_center", "mid_l"))).alias("m"), F.avg("mid_l").alias("lateral_m"))
    at = lambda k: F.element_at("m", F.greatest(k, F.lit(1)).cast("int"))
    rise = lambda a, b: F.when(F.abs(at(b).s_center - at(a).s_center) >= 1e-6,
        (at(b).mid_l - at(a).mid_l) / (at(b).s_center - at(a).s_center))
    n, one = F.size("m"), F.lit(1)
    rows = rows.withColumns({"sections": n, "span_m": F.when(n >= 2, at(n).s_center - at(one).s_center), "direction": F.when(n >= 2, rise(one, n))})
    half = F.greatest(F.lit(2), F.floor(n / 2))
    turn = F.when((n >= 3) & (F.col("span_m") + 1e-9 >= cfg.min_span_m), F.abs(rise(half, n) - rise(one, half)))
    rows = rows.withColumn("direction_change", turn).drop("m").join(scored.select(*keys, "kind", "shared_with"), keys, "left")
    mine = F.lit(False)
    if own is not None:
        rows = rows.join(own.select(*keys).distinct().withColumn("own", F.lit(True)), keys, "left")
        mine = F.coalesce("own", F.lit(False))
    turns = F.coalesce(F.col("direction_change") > cfg.heading, F.lit(False))
    rows = rows.withColumns({
        "offset": F.abs(F.col("lateral_m") - profile.center_l_m) > profile.width_m / 2, "turns": turns,
        "constant_heading": F.coalesce((F.abs("direction") > cfg.heading) & ~turns, F.lit(False)),
        "weak": ~F.coalesce(F.col("kind") == "consistent",
            F.lit(False)) | (F.col("sections") < 3) | F.col("span_m").isNull() | (F.col("span_m") < cfg.min_span_m),
        "shared": F.coalesce(F.col("shared_with") > 0, F.lit(False)),
    })
    reason = F.when(F.col("weak") | F.col("shared"), "weak_or_shared").when(F.col("offset"), "offset").when(F.col("turns") & ~mine,
        "turns_of_unknown_owner").when(F.col("constant_heading"), "constant_heading").otherwise("no_contradiction")
    forbids = ~F.col("weak") & ~F.col("offset") & ~F.col("shared") & F.col("turns") & mine
    return rows.withColumns({"reason": reason, "forbids": forbids}).drop("own")


def applicable(frames: DataFrame, axis: DataFrame) -> DataFrame:
    """``frames`` with ``profile_applicable``: no pair of the frame forbids the straight profile."""
    against = axis.where("forbids").select("frame_index").distinct().withColumn("against", F.lit(True))
    return frames.join(against, "frame_index", "left").withColumn("profile_applicable", F.col("against").isNull()).drop("against")
