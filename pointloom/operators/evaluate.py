"""Evaluation: run summaries, funnels, inserted objects, face location, comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Statuses of frames that gave nothing.
FAILED = ("insufficient_geometry", "no_hypotheses", "error")


def run_summary(frames: DataFrame) -> DataFrame:
    """Status counts, shares and times of a run. ``frames``: run, frame_index, status, support, seconds."""
    is_ = lambda *names: F.col("status").isin(*names)
    missed = is_("insufficient_geometry", "no_hypotheses")
    return frames.groupBy("run").agg(
        F.count("*").alias("frames"), F.count_if(is_("ok")).alias("ok"), F.count_if(is_("error")).alias("errors"),
            F.count_if(missed).alias("no_geometry"), F.avg(missed.cast("double")).alias("share_no_geometry"),
        F.min("support").alias("support_min"), F.max("support").alias("support_max"), F.percentile("seconds", F.lit(0.5)).alias("p50_s"),
            F.percentile("seconds", F.lit(0.95)).alias("p95_s"), F.sum("seconds").alias("sum_s"),
    )


def candidate_totals(cands: DataFrame) -> DataFrame:
    """Candidates and their points of each hypothesis by kind and branch; sums over hypotheses are no number of objects."""
    return cands.groupBy("hypothesis", "branch", "kind").agg(F.count("*").alias("candidates"), F.sum("unique_xyz").alias("points"))


def pick_frames(frames: DataFrame) -> DataFrame:
    """The frame with most candidates of one hypothesis (``candidates``; the first on ties), and the first frame of the commonest failure."""
    most = frames.agg(F.max_by(F.struct("frame_index", F.col("candidates").alias("n")),
            F.struct("candidates", -F.col("frame_index"))).alias("x")).select(F.lit("most_candidates").alias("why"), "x.*")
    fails = frames.where(F.col("status").isin(*FAILED)).groupBy("status").agg(F.count("*").alias("n"), F.min("frame_index").alias("frame_index"))
    worst = fails.agg(F.max_by(F.struct("frame_index", "n"), F.struct("n",
                -F.col("frame_index"))).alias("x")).select(F.lit("commonest_failure").alias("why"), "x.*")
    return most.unionByName(worst).where("frame_index is not null")


def funnel(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points left after each mask, in the order of the detector."""
    stages = ["inside", "not excluded", "not explained", "not ambiguous"]
    return points.groupBy(*(by or ["frame_index"])).agg(F.count("*").alias("points"),
        *[F.count_if(F.expr(" and ".join(stages[: k + 1]))).alias(n) for k,
            n in enumerate(("in_volume", "off_lines", "off_surface", "in_pool"))])


def insertion(marked: DataFrame, cands: DataFrame, inserted: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """What became of inserted points (frame_index, point_id, range_m), by frame, told after the detection.

    ``marked``: all points with their masks; ``prior``: candidates of the same frames before the insertion. A candidate
    is an insertion's where more than half of it was inserted; one that takes in points of an earlier candidate, or
    is mostly others' points, is merged with the background.
    """
    key = ["frame_index", "point_id"]
    seen = inserted.select(*key, "range_m").join(marked.select(*key, "inside", "excluded", "explained", "ambiguous"), key, "left")
    on_line, layer = F.col("inside") & F.col("excluded"), F.col("inside") & F.col("ambiguous") & ~F.col("excluded")
    pool = F.expr("inside and not excluded and not explained and not ambiguous")
    truth = seen.groupBy("frame_index").agg(F.count("*").alias("inserted"), F.count_if("inside").alias("inside"),
        F.count_if(on_line).alias("on_lines"), F.count_if(layer).alias("in_layer"), F.count_if(pool).alias("in_pool"))
    members = cands.select("frame_index", "candidate_id", "unique_xyz", "range_from_sensor_m",
        F.explode("members").alias("point_id")).join(inserted.select(*key, "range_m"), key, "left")
    each = members.groupBy("frame_index", "candidate_id", "unique_xyz", "range_from_sensor_m").agg(F.count("range_m").alias("hits"),
        F.min("range_m").alias("true_range_m")).where("hits > 0")
    if prior is None:
        each = each.withColumn("overlaps", F.lit(False))
    else:
        before = prior.select("frame_index", F.explode("members").alias("point_id")).distinct().withColumn("before", F.lit(True))
        again = members.where("range_m is null").join(before, key).select("frame_index", "candidate_id").distinct().withColumn("overlaps",
            F.lit(True))
        each = each.join(again, ["frame_index", "candidate_id"], "left").fillna(False, ["overlaps"])
    each = each.withColumns({"share": F.col("hits") / F.col("unique_xyz"),
        "range_error_m": F.abs(F.col("range_from_sensor_m") - F.col("true_range_m"))})
    each = each.withColumn("merged", F.col("overlaps") | ((F.col("hits") < F.col("unique_xyz")) & (F.col("share") <= 0.5)))
    best = each.groupBy("frame_index").agg(F.sum("hits").alias("hits"), F.count("*").alias("pieces"),
        F.bool_or(F.col("share") > 0.5).alias("mostly"), F.bool_or("merged").alias("merged"),
        F.max_by(F.struct("candidate_id", "share", "range_error_m"), F.struct("hits", "share", "candidate_id")).alias("best"))
    out = truth.join(best, "frame_index", "left").fillna(0, ["hits", "pieces"]).fillna(False, ["mostly", "merged"])
    outcome = (
        F.when(F.col("inside") == 0, "outside_corridor").when(F.col("mostly"), "predominantly_insertion").when(F.col("merged"),
            "merged_with_background")
        .when((F.col("in_layer") > 0) & (F.col("hits") == 0), "ambiguous_layer_only").when((F.col("on_lines") > 0) & (F.col("hits") == 0),
            "excluded_by_path_volume").otherwise("no_candidate")
    )
    return out.select("frame_index", "inserted", "inside", "in_pool", "in_layer", "on_lines", "hits", "pieces", "best.*", outcome.alias("outcome"))


def prior_overlap(now: DataFrame, before: DataFrame) -> DataFrame:
    """Candidates that share members with a candidate of an earlier result."""
    b = before.select("frame_index", F.col("candidate_id").alias("prior_id"), F.col("members").alias("prior"))
    return now.join(b, "frame_index").where(F.arrays_overlap("members", "prior")).select("frame_index", "candidate_id", "prior_id",
        F.size(F.array_intersect("members", "prior")).alias("common"))


def faces(points: DataFrame, gate: Column | None = None, min_l_m: float = 0.0, min_h_m: float = 0.0, need: int = 40,
    core_need: int = 30) -> DataFrame:
    """A dense thin slab across the path in each frame, and whether it is a face apart from floor and walls.

    Of the bins along s that are full and wide enough the fullest starts a slab of 0.40 m; what stands above the floor
    band of it is the core, and the percentiles of the core its extent. Frames without a slab have no row.
    """
    rows = points.where(gate) if gate is not None else points
    rows = rows.withColumn("bin", F.floor(F.col("s") / 0.25).cast("int"))
    full = rows.groupBy("frame_index", "bin").agg(F.count("*").alias("n"), (F.max("l") - F.min("l")).alias("wide"),
        (F.max("h") - F.min("h")).alias("tall"))
    full = full.where((F.col("n") >= need) & (F.col("wide") >= min_l_m) & (F.col("tall") >= min_h_m))
    best = full.groupBy("frame_index").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin")).select("frame_index",
        (F.col("bin") * 0.25).alias("s_lo_m"))
    slab = rows.join(best, "frame_index").where((F.col("s") >= F.col("s_lo_m")) & (F.col("s") < F.col("s_lo_m") + 0.40))
    w = Window.partitionBy("frame_index")
    slab = slab.withColumns({"wide": F.max("l").over(w) - F.min("l").over(w), "core": F.col("h") >= F.percentile("h", F.lit(0.12)).over(w) + 0.05})
    of = lambda f: f(F.when(F.col("core"), F.col("h")))
    at = lambda c, p: F.percentile(F.when(F.col("core"), F.col(c)), F.lit(p))
    out = slab.groupBy("frame_index", "s_lo_m").agg(
        F.count("*").alias("n"), F.max("wide").alias("wide"), F.count_if("core").alias("core"), (of(F.max) - of(F.min)).alias("core_h"),
        at("l", 0.04).alias("l_p4"), at("l", 0.96).alias("l_p96"), at("h", 0.04).alias("h_p4"), at("h", 0.96).alias("h_p96"),
    ).where(F.col("n") >= need)
    reason = F.when(F.col("wide") > 3.6, "spans_the_tunnel").when((F.col("core") < core_need) | (F.col("core_h") < 0.45),
        "not_apart_from_the_floor").otherwise("separated")
    out = out.withColumn("reason", reason)
    apart = F.col("reason") == "separated"
    return out.select("frame_index", "s_lo_m", "n", "core", "reason", *[F.when(apart, F.col(c)).alias(c) for c in ("l_p4", "l_p96", "h_p4", "h_p96")])


def region_hits(cands: DataFrame, region: DataFrame, hits_needed: int = 4, share_needed: float = 0.5) -> DataFrame:
    """Candidates by the points of a region (frame_index, point_id) that they hold; the best one localises first, then has most."""
    hits = cands.select("frame_index", "candidate_id", "unique_xyz",
        F.explode("members").alias("point_id")).join(region.select("frame_index", "point_id"), ["frame_index", "point_id"])
    c = hits.groupBy("frame_index", "candidate_id", "unique_xyz").agg(F.count("*").alias("hits"))
    c = c.withColumn("localising", (F.col("hits") >= hits_needed) & (F.col("hits") / F.col("unique_xyz") >= share_needed))
    return c.groupBy("frame_index").agg(F.max_by(F.struct("candidate_id", "hits", "localising"),
            F.struct("localising", "hits", "candidate_id")).alias("best")).select("frame_index", "best.*")


def compare(expected: DataFrame, actual: DataFrame, exact: list[str], near: list[str], tolerance: float = 1e-5) -> DataFrame:
    """One row for each difference of two results by frame: missing frames, differing fields."""
    a = expected.select("frame_index", *[F.col(c).alias(f"e_{c}") for c in exact + near], F.lit(1).alias("e"))
    b = actual.select("frame_index", *[F.col(c).alias(f"a_{c}") for c in exact + near], F.lit(1).alias("a"))
    both = a.join(b, "frame_index", "full_outer")
    here = F.col("e").isNotNull() & F.col("a").isNotNull()
    close = lambda c: (F.col(f"e_{c}").isNull() & F.col(f"a_{c}").isNull()) | F.coalesce(F.abs(F.col(f"e_{c}") - F.col(f"a_{c}")) <= tolerance,
        F.lit(False))
    checks = [F.when(F.col("a").isNull(), "missing_frame"), F.when(F.col("e").isNull(), "unexpected_frame")]
    checks += [F.when(here & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), c) for c in exact] + [F.when(here & ~close(c), c) for c in near]
    return both.select("frame_index", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("difference"))


def compare_candidates(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Differences of the candidates of two results, place by place in each frame, the first of each frame.

    Both: frame_index, place, hypothesis, candidate_id, kind, branch, members (array), range_from_sensor_m.
    """
    exact = ["hypothesis", "candidate_id", "kind", "branch", "members"]
    side = lambda df, p: df.select("frame_index", "place",
        *[(F.sort_array(c) if c == "members" else F.col(c)).alias(f"{p}_{c}") for c in exact], F.col("range_from_sensor_m").alias(f"{p}_r"),
        F.lit(1).alias(p))
    both = side(expected, "e").join(side(actual, "a"), ["frame_index", "place"], "full_outer")
    same = F.lit(True)
    for c in exact:
        same &= F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))
    odd = F.isnan("a_r") | (F.abs("a_r") == float("inf")) | F.isnan("e_r") | (F.abs("e_r") == float("inf"))
    close = F.col("e_r").eqNullSafe(F.col("a_r")) | F.coalesce(F.abs(F.col("e_r") - F.col("a_r")) <= tolerance, F.lit(False))
    what = F.when(F.col("e").isNull() | F.col("a").isNull(), "number").when(F.coalesce(odd, F.lit(False)), "range_not_finite").when(~same,
        "members").when(~close, "range")
    found = both.withColumn("difference", what).where("difference is not null")
    # another number of candidates is told first, then the first place that differs
    return found.groupBy("frame_index").agg(F.min_by(F.struct("difference", "place"),
            F.struct(F.col("difference") != "number", "place")).alias("d")).select("frame_index", "d.*")


def frame_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Frames of one result only."""
    a, b = expected.select("frame_index").distinct(), actual.select("frame_index").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("actual")))


def duplicates(frames: DataFrame, order: str) -> DataFrame:
    """Frames that a journal has more than once, with the first and the last record of each."""
    w = Window.partitionBy("frame_index")
    return frames.withColumn("n", F.count("*").over(w)).where("n > 1").groupBy("frame_index", "n").agg(F.min(order).alias("first"),
        F.max(order).alias("last"))


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def balance(counters: DataFrame) -> DataFrame:
    """Whether every frame that came in is accounted for."""
    total = sum((F.col(c) for c in ("written", "dropped", "timeout", "failed")), F.lit(0))
    return counters.withColumns({"accounted": total, "balanced": total == F.col("received")})


def playback_counters(answers: DataFrame) -> DataFrame:
    """What became of the frames of each run that was played one by one, and how many stamps came again (run, sequence, stamp_ns, status)."""
    w = Window.partitionBy("run").orderBy("sequence")
    rows = answers.withColumn("again", F.coalesce(F.col("stamp_ns") == F.lag("stamp_ns").over(w), F.lit(False)))
    is_ = lambda *names: F.col("status").isin(*names)
    counted = {"ok": is_("ok"), "timeout": is_("processing_timeout"), "expired": is_("player_wait_expired")}
    other = ~F.coalesce(is_("ok", "processing_timeout", "player_wait_expired"), F.lit(False))
    return rows.groupBy("run").agg(F.count("*").alias("played"), *[F.count_if(c).alias(n) for n, c in counted.items()],
        F.count_if(other).alias("error"), F.count_if("again").alias("repeated_stamps"))


def reference_range(region: DataFrame) -> DataFrame:
    """The nearest and the farthest range of a region's points (frame_index, range_m), and what lies between."""
    out = region.groupBy("frame_index").agg(F.min("range_m").alias("min_m"), F.max("range_m").alias("max_m"), F.count("*").alias("points"))
    return out.withColumn("uncertainty_m", F.col("max_m") - F.col("min_m"))


def two_ways(a: DataFrame, b: DataFrame, region: DataFrame, axes: DataFrame) -> DataFrame:
    """One frame's region in the candidates of the full pipeline (``a``) and of the plain straight volume (``b``), side by side.

    ``axes``: lateral places of the hypotheses' axes (frame_index, axis_l_m); where they are spread or off, a straight
    volume names no track, and where there are none nothing is said.
    """
    side = lambda df, p: region_hits(df, region).select("frame_index",
        *[F.col(c).alias(f"{p}_{c}") for c in ("candidate_id", "hits", "localising")])
    spread = axes.groupBy("frame_index").agg((F.max("axis_l_m") - F.min("axis_l_m")).alias("spread_m"), F.max(F.abs("axis_l_m")).alias("off_m"))
    out = region.select("frame_index").distinct().join(side(a, "a"), "frame_index", "left").join(side(b, "b"), "frame_index",
        "left").join(spread, "frame_index", "left")
    return out.withColumn("ambiguous", (F.col("spread_m") > 0.40) | (F.col("off_m") > 0.50))
