"""Pairs of longitudinal lines: distance across the track, agreement, a midpoint line, a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import GROUND, PAIRS, Ground, Pairs
from .ground import segment_of


def heading(s: str, l: str, over: Window) -> Column:  # noqa: E741
    """Central difference inside, one-sided at the ends."""
    near = lambda c, k: F.coalesce(F.lag(c, k).over(over), F.col(c))
    ds = near(s, -1) - near(s, 1)
    return F.when(F.abs(ds) >= 1e-9, (near(l, -1) - near(l, 1)) / ds)


def line_distance(ds: Column, dl: Column, dh: Column, k: Column, bs: Column, bl: Column) -> Column:
    """Distance of two points across a track of heading k on ground with slopes bs and bl.

    The lateral axis is normal x tangent; its length is divided out instead of normalising each vector.
    """
    ts, tl, th = F.lit(1.0), k, bs + bl * k
    ns, nl, nh = -bs, -bl, F.lit(1.0)
    a, b, c = nl * th - nh * tl, nh * ts - ns * th, ns * tl - nl * ts
    return F.abs(ds * a + dl * b + dh * c) / F.sqrt(a * a + b * b + c * c)


def measure_sections(fragments: DataFrame, slopes: DataFrame) -> DataFrame:
    """Every two lines of a frame (a left of b) at the stations that both have.

    ``fragments``: frame_index, track, s_center, l_median, h_median, dh_median, width_m, groups;
    ``slopes``: frame_index, s_center, slope_s, slope_l.
    """
    order = Window.partitionBy("frame_index", "track")
    own = fragments.withColumn("l_track", F.median("l_median").over(order))
    side = lambda p: own.select("frame_index", "s_center", *[F.col(c).alias(f"{p}_{c}") for c in ("track", "l_track", "l_median",
                "h_median", "dh_median", "width_m", "groups")])
    both = side("a").join(side("b"), ["frame_index", "s_center"]).where("(a_l_track, a_track) < (b_l_track, b_track)")
    pair = Window.partitionBy("frame_index", "a_track", "b_track")
    both = both.withColumns({"common": F.count("*").over(pair), "mid_l": (F.col("a_l_median") + F.col("b_l_median")) / 2,
        "mid_h": (F.col("a_h_median") + F.col("b_h_median")) / 2})
    both = both.where("common >= 2").withColumn("heading", heading("s_center", "mid_l", pair.orderBy("s_center")))
    both = both.join(slopes, ["frame_index", "s_center"]).where("heading is not null")
    return both.withColumn("distance_m", line_distance(F.lit(0.0), F.col("b_l_median") - F.col("a_l_median"),
            F.col("b_h_median") - F.col("a_h_median"), F.col("heading"), F.col("slope_s"), F.col("slope_l")))


def agreeing(sections: DataFrame, cfg: Pairs = PAIRS) -> DataFrame:
    """Sections of pairs whose median distance is in range, without those away from the median."""
    pair = Window.partitionBy("frame_index", "a_track", "b_track")
    rows = sections.withColumns({"center": F.median("distance_m").over(pair), "usable": F.count("*").over(pair)})
    rows = rows.where((F.col("usable") >= cfg.min_sections) & F.col("center").between(cfg.min_distance_m,
        cfg.max_distance_m) & (F.abs(F.col("distance_m") - F.col("center")) <= cfg.agree_m))
    return rows.withColumn("agree", F.count("*").over(pair)).where(F.col("agree") >= cfg.min_sections)


def median_slope_line(rows: DataFrame, keys: list[str], s: str, l: str, cfg: Pairs = PAIRS) -> DataFrame:  # noqa: E741
    """The line c(s) = b + k s of each key: k is the median of the slopes of all point pairs, b the median rest.

    Points of a key are a handful of stations, so their pairs are too.
    """
    pts = rows.select(*keys, F.col(s).alias("s1"), F.col(l).alias("l1"))
    other = rows.select(*keys, F.col(s).alias("s2"), F.col(l).alias("l2"))
    k = pts.join(other,
        keys).where("s2 - s1 >= 1e-9").groupBy(*keys).agg(F.median((F.col("l2") - F.col("l1")) / (F.col("s2") - F.col("s1"))).alias("k"))
    w = Window.partitionBy(*keys)
    rest = pts.join(k, keys).withColumn("b", F.median(F.col("l1") - F.col("k") * F.col("s1")).over(w)).withColumn("r",
        F.abs(F.col("l1") - F.col("b") - F.col("k") * F.col("s1")))
    out = rest.groupBy(*keys, "k", "b").agg(F.count("*").alias("n_sections"), F.min("s1").alias("s_min"), F.max("s1").alias("s_max"),
        F.median("r").alias("residual_p50_m"), F.percentile("r", F.lit(0.95)).alias("residual_p95_m"))
    return out.withColumn("straight", (F.col("n_sections") >= 3) & (F.col("residual_p95_m") <= cfg.straight_p95_m))


def pose_at_reference(rows: DataFrame, lines: DataFrame, keys: list[str], cfg: Pairs = PAIRS) -> DataFrame:
    """The midpoint at the reference station: what was seen there or nearest, and what the line says, each under its own name.

    The line's value is given only where it is straight and not too far outside of its sections; it is never an observation.
    """
    ref = cfg.reference_s_m
    near = rows.groupBy(*keys).agg(F.min_by(F.struct("s_center", "mid_l"), F.struct(F.abs(F.col("s_center") - ref), "s_center")).alias("n"))
    out = near.join(lines, keys, "left")
    direct = F.abs(F.col("n.s_center") - ref) <= 1e-6
    outside = F.greatest(F.col("s_min") - ref, ref - F.col("s_max"), F.lit(0.0))
    support = F.when(outside > 1e-9, "extrapolation").when(direct, "observed").otherwise("gap")
    reliable = F.coalesce(F.col("straight") & (outside <= cfg.extrapolate_m), F.lit(False))
    reason = F.when(F.col("k").isNull(), "no_line").when(~F.col("straight"), "not_straight").when(outside > cfg.extrapolate_m,
        "too_far").otherwise("reliable")
    return out.select(
        *keys, support.alias("support"), F.when(direct, F.col("n.mid_l")).alias("direct_l_m"), F.col("n.s_center").alias("nearest_s_m"),
            F.col("n.mid_l").alias("nearest_l_m"),
        F.when(reliable, F.col("b") + F.col("k") * ref).alias("model_l_m"), outside.alias("outside_m"), reliable.alias("reliable"),
            reason.alias("reason"),
    )


def pairs(sections: DataFrame, cfg: Pairs = PAIRS) -> DataFrame:
    """One row for each pair: distance and its spread over agreeing sections, support, where it is published."""
    keys = ["frame_index", "a_track", "b_track"]
    rows = agreeing(sections, cfg)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("mad", F.abs(F.col("distance_m") - F.median("distance_m").over(w)))
    return rows.groupBy(*keys).agg(
        F.median("distance_m").alias("distance_m"), F.median("mad").alias("distance_mad_m"), F.median("a_l_median").alias("left_l_m"),
            F.median("b_l_median").alias("right_l_m"),
        F.sum(F.col("a_groups") + F.col("b_groups")).alias("support_groups"), F.count("*").alias("sections"),
            F.min_by("s_center", F.struct(F.abs(F.col("s_center") - cfg.reference_s_m), "s_center")).alias("publish_s_m"),
    )


def assumed_sections(fragments: DataFrame) -> DataFrame:
    """Stations between the first and the last that two lines share where one of them is missing.

    The missing side is put the median separation of the shared stations away; it is never an observation. Lines that share
    fewer than two stations say nothing of each other.
    """
    keys = ["frame_index", "a_track", "b_track"]
    f = fragments.select("frame_index", "track", "s_center", "l_median")
    tracks = f.groupBy("frame_index", "track").agg(F.median("l_median").alias("at"))
    side = lambda p: tracks.select("frame_index", F.col("track").alias(f"{p}_track"), F.col("at").alias(f"{p}_at"))
    two = side("a").join(side("b"), "frame_index").where("(a_at, a_track) < (b_at, b_track)").select(*keys)
    seen = two.select(*keys, F.explode(F.array("a_track", "b_track")).alias("track")).join(f, ["frame_index", "track"])
    own = lambda p: F.max(F.when(F.col("track") == F.col(f"{p}_track"), F.col("l_median")))
    both = seen.groupBy(*keys, "s_center").agg(own("a").alias("a"), own("b").alias("b"))
    w, gap = Window.partitionBy(*keys), F.col("b") - F.col("a")  # the gap is null where one side is missing
    shared = F.when(gap.isNotNull(), F.col("s_center"))
    both = both.withColumns({"separation": F.median(gap).over(w), "shared": F.count(gap).over(w), "lo": F.min(shared).over(w), "hi": F.max(shared).over(w)})
    return both.where("shared >= 2 and s_center between lo and hi and (a is null or b is null)").select(*keys, "s_center",
        F.coalesce("a", F.col("b") - F.col("separation")).alias("a_l_m"), F.coalesce("b", F.col("a") + F.col("separation")).alias("b_l_m"),
        F.when(F.col("a").isNull(), "a").otherwise("b").alias("assumed"))


def scores(sections: DataFrame, residual: DataFrame, assumed: DataFrame, cfg: Pairs = PAIRS) -> DataFrame:
    """The engineering score of each pair, the least of six parts, its kind and its rivals."""
    keys = ["frame_index", "a_track", "b_track"]
    w = Window.partitionBy(*keys).orderBy("s_center")
    rows = agreeing(sections, cfg)
    step = lambda c: (F.col(c) - F.lag(c).over(w)) / (F.col("s_center") - F.lag("s_center").over(w))
    rows = rows.withColumn("dk", F.abs(step("a_l_median") - step("b_l_median")))
    p = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median("dk").alias("dk"), (F.max("distance_m") - F.min("distance_m")).alias("span"),
            F.median(F.col("b_dh_median") - F.col("a_dh_median")).alias("dh"),
        F.max(F.greatest("a_width_m", "b_width_m")).alias("width"), F.median("distance_m").alias("distance_m"),
    )
    p = p.join(residual.select("frame_index", "p95_m"), "frame_index",
        "left").join(assumed.groupBy(*keys).agg(F.count("*").alias("assumed")), keys, "left").fillna(0, ["assumed"])
    one = F.lit(1.0)
    parts = {
        "support": F.least(one, F.col("n") / 3.0),
        "direction": F.coalesce(one - F.least(one, F.col("dk") / cfg.direction_scale), one),
        "stability": one - F.least(one, F.col("span") / cfg.distance_span_m),
        "height": F.coalesce(one - F.least(one, F.abs("dh") / F.greatest(F.coalesce("p95_m", F.lit(0.0)), F.lit(cfg.height_floor_m))), one),
        "narrow": F.when(F.col("width") <= cfg.wide_m, one).otherwise(cfg.wide_score),
        "observed": F.when(F.col("assumed") == 0, one).otherwise(F.greatest(F.lit(0.0), one - F.col("assumed") / F.greatest("n", F.lit(1)))),
    }
    p = p.withColumns(parts).withColumn("score", F.least(*parts))
    bad = (F.coalesce(F.col("dk"), F.lit(0.0)) > cfg.slope_difference) | (F.col("span") > cfg.distance_span_m)
    penalties = (F.col("support") < 1).cast("int") + (F.col("direction") < 0.5).cast("int") + (F.col("stability") < 0.5).cast("int") + (F.col("height") < 0.5).cast("int") + (F.col("narrow") < 1).cast("int") + (F.col("assumed") > 0).cast("int")
    p = p.withColumns({"inconsistent": bad, "penalties": penalties})
    p = p.withColumn("kind", F.when(bad | (F.col("score") < cfg.weak_score),
            "insufficient").when((F.col("score") >= cfg.strong_score) & (F.col("penalties") == 0), "consistent").otherwise("ambiguous"))
    ends = p.select("frame_index", F.explode(F.array("a_track", "b_track")).alias("line"), F.struct("a_track", "b_track").alias("id"), "score")
    rival = ends.join(ends.withColumnsRenamed({"id": "other", "score": "its"}),
        ["frame_index", "line"]).where("id <> other").groupBy("frame_index", "id").agg(F.count_distinct("other").alias("shared_with"),
        F.min(F.abs(F.col("score") - F.col("its"))).alias("closest"))
    p = p.withColumn("id", F.struct("a_track", "b_track")).join(rival, ["frame_index", "id"], "left").drop("id").fillna(0, ["shared_with"])
    lowered = (F.col("kind") == "consistent") & (F.col("closest") <= cfg.rival_score)
    return p.withColumn("kind", F.when(lowered, "ambiguous").otherwise(F.col("kind"))).drop("closest")


def shifted(rows: DataFrame, shift_l: float, yaw: float) -> DataFrame:
    """Points (s, l) as a sensor sees them that is moved by ``shift_l`` and turned by ``yaw``."""
    import math

    c, k = math.cos(yaw), math.sin(yaw)
    moved = F.col("l") - shift_l
    return rows.withColumns({"s": F.col("s") * c + moved * k, "l": -F.col("s") * k + moved * c})


def same_place_cut(left: DataFrame, right: DataFrame, stations: list[float]) -> DataFrame:
    """Lateral separation of two polylines (frame_index, s, l) at stations, by linear interpolation inside both."""
    def at(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("frame_index").orderBy("s")
        piece = df.select("frame_index", "s", "l", F.lead("s").over(w).alias("s1"), F.lead("l").over(w).alias("l1")).where("s1 is not null")
        hit = piece.withColumn("station", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in stations]),
                    lambda x: (x >= F.col("s")) & (x <= F.col("s1")))))
        return hit.groupBy("frame_index",
            "station").agg(F.min_by(F.col("l") + (F.col("station") - F.col("s")) / (F.col("s1") - F.col("s")) * (F.col("l1") - F.col("l")),
                "s").alias(name))

    return at(left, "a").join(at(right, "b"), ["frame_index", "station"]).withColumn("delta_l", F.col("b") - F.col("a"))


def distance_of_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median distance of corresponding points of two lines (a_s, a_l, a_h and b_s, b_l, b_h), across their local heading.

    The base is the least-squares plane through both lines, by sums; headings are those of the midpoints.
    """
    ends = rows.select(*keys,
        F.explode(F.array(*[F.struct(*[F.col(f"{e}_{c}").alias(c) for c in "slh"]) for e in "ab"])).alias("p")).select(*keys, "p.*")
    v = lambda a, b: F.covar_pop(a, b)
    sums = ends.groupBy(*keys).agg(v("s", "s").alias("ss"), v("l", "l").alias("ll"), v("s", "l").alias("sl"), v("s", "h").alias("sh"),
        v("l", "h").alias("lh"))
    c = {x: F.col(x) for x in ("ss", "ll", "sl", "sh", "lh")}
    det = c["ss"] * c["ll"] - c["sl"] * c["sl"]
    flat = lambda x: F.coalesce(F.try_divide(x, F.when(det > 1e-12 * c["ss"] * c["ll"], det)), F.lit(0.0))
    plane = sums.select(*keys, flat(c["sh"] * c["ll"] - c["lh"] * c["sl"]).alias("slope_s"),
        flat(c["lh"] * c["ss"] - c["sh"] * c["sl"]).alias("slope_l"))
    mid = rows.withColumns({"mid_s": (F.col("a_s") + F.col("b_s")) / 2, "mid_l": (F.col("a_l") + F.col("b_l")) / 2})
    mid = mid.withColumn("heading", heading("mid_s", "mid_l", Window.partitionBy(*keys).orderBy("mid_s"))).join(plane, keys)
    gap = {x: F.col(f"b_{x}") - F.col(f"a_{x}") for x in "slh"}
    d = line_distance(gap["s"], gap["l"], gap["h"], F.col("heading"), F.col("slope_s"), F.col("slope_l"))
    return mid.withColumn("d", d).groupBy(*keys).agg(F.median("d").alias("distance_m"), F.median(F.abs(gap["l"])).alias("same_s_delta_l_m"),
        F.count("*").alias("points"))


def feature_table(sections: DataFrame) -> DataFrame:
    """Features of each pair side by side, as arrays over its stations."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("s_center", F.col(c).alias("v")))), lambda x: x.v)
    return sections.groupBy("frame_index", "a_track", "b_track").agg(*[by(c).alias(c) for c in ("s_center", "distance_m", "a_l_median",
                "b_l_median", "a_width_m", "b_width_m", "a_groups", "b_groups")])


def stations(fragments: DataFrame) -> DataFrame:
    """For every two lines of a frame the stations that both have, and those inside both spans that one lacks."""
    own = fragments.groupBy("frame_index", "track").agg(F.sort_array(F.collect_set(F.round("s_center", 3))).alias("at"))
    a = own.select("frame_index", F.col("track").alias("a_track"), F.col("at").alias("a"))
    b = own.select("frame_index", F.col("track").alias("b_track"), F.col("at").alias("b"))
    both = a.join(b, "frame_index").where("a_track < b_track")
    low, high = F.greatest(F.array_min("a"), F.array_min("b")), F.least(F.array_max("a"), F.array_max("b"))
    common = F.array_intersect("a", "b")
    one = F.array_except(F.array_union("a", "b"), common)
    return both.select("frame_index", "a_track", "b_track", F.sort_array(common).alias("common"),
        F.sort_array(F.filter(one, lambda s: s.between(low, high))).alias("missing"))


def line_samples(pair_of: DataFrame, fragments: DataFrame, lines: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """The sections of the two lines that made each hypothesis (frame_index, hypothesis, a_track, b_track), with the support of their heights."""
    ground = lines.select("frame_index", "segment", F.col("l_min").alias("g_min"), F.col("l_max").alias("g_max"))
    rows = fragments.withColumn("segment", segment_of("s_center", cfg)).join(ground, ["frame_index", "segment"], "left")
    rows = rows.withColumn("supported", F.coalesce(F.col("l_median").between(F.col("g_min"), F.col("g_max")), F.lit(False)))
    own = pair_of.select("frame_index", "hypothesis", F.explode(F.array("a_track", "b_track")).alias("track"))
    return own.join(rows, ["frame_index", "track"]).select("frame_index", "hypothesis", "s_center", "l_median", "h_median", "width_m", "supported")
