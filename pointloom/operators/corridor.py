"""A corridor along a polyline of track midpoints, and where points lie in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import GROUND, PAIRS, PROFILE, Attachment, Ground, Profile

KEY = ("frame_index", "hypothesis")


def _surface(vertices: DataFrame, lines: DataFrame, cfg: Ground) -> DataFrame:
    """Reference height, slope and lateral support of the ground under each vertex."""
    from .ground import segment_of

    small = lines.select("frame_index", "segment", "intercept", "slope_dh_dl", "l_min", "l_max")
    out = vertices.withColumn("segment", segment_of("s", cfg)).join(small, ["frame_index", "segment"], "left")
    return out.withColumns({"h_ref": F.col("intercept") + F.col("slope_dh_dl") * F.col("l"), "slope": F.col("slope_dh_dl"),
            "reference": F.coalesce(F.col("l").between(F.col("l_min"), F.col("l_max")), F.lit(False))}).drop("segment", "intercept",
        "slope_dh_dl", "l_min", "l_max")


def vertices(midpoints: DataFrame, lines: DataFrame, attachment: tuple[float, float] | None = None, cfg: Ground = GROUND,
    extra_m: float = PAIRS.extrapolate_m) -> DataFrame:
    """Vertices of each hypothesis: observed (``midpoints``: frame_index, hypothesis, s, l), ends
    extrapolated along the outer segments, stations between that are missing, and a prior place ahead.
    Of vertices at one place the observed one stays.
    """
    w = Window.partitionBy(*KEY).orderBy("s")
    seen = midpoints.select(*KEY, "s", "l").withColumns({"ps": F.lag("s").over(w), "pl": F.lag("l").over(w), "ns": F.lead("s").over(w),
            "nl": F.lead("l").over(w)})
    observed = seen.select(*KEY, "s", "l", F.lit("observed").alias("role"))
    slope = lambda a, b, c, d: F.when(F.col(c) == F.col(a), 0.0).otherwise((F.col(d) - F.col(b)) / (F.col(c) - F.col(a)))
    head = seen.where("ps is null and ns is not null").select(*KEY, (F.col("s") - extra_m).alias("s"),
        (F.col("l") - slope("s", "l", "ns", "nl") * extra_m).alias("l"), F.lit("extrapolated").alias("role"))
    tail = seen.where("ns is null and ps is not null").select(*KEY, (F.col("s") + extra_m).alias("s"),
        (F.col("l") + slope("ps", "pl", "s", "l") * extra_m).alias("l"), F.lit("extrapolated").alias("role"))
    between = F.filter(F.array(*[F.lit(float(x)) for x in cfg.section_s_m]), lambda x: (x > F.col("s") + 5e-4) & (x < F.col("ns") - 5e-4))
    gaps = seen.where("ns is not null").withColumn("at", F.explode(between)).select(*KEY, F.col("at").alias("s"),
        (F.col("l") + (F.col("at") - F.col("s")) / (F.col("ns") - F.col("s")) * (F.col("nl") - F.col("l"))).alias("l"),
        F.lit("gap_interpolation").alias("role"))
    parts = [observed, gaps] + ([head, tail] if extra_m > 0 else [])
    if attachment is not None:
        first = seen.where("ps is null").where(F.lit(attachment[0]) < F.col("s") - 1e-6)
        parts.append(first.select(*KEY, F.lit(attachment[0]).alias("s"), F.lit(attachment[1]).alias("l"), F.lit("attachment_prior").alias("role")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(*KEY, F.round(F.col("s") * 1e6)).orderBy((F.col("role") != "observed").cast("int"), "role"))
    return _surface(every.withColumn("n", rank).where("n = 1").drop("n"), lines, cfg)


def segments(vertex: DataFrame) -> DataFrame:
    """Segments between neighbouring vertices with the weaker role of the two and the arc at their start."""
    w = Window.partitionBy(*KEY).orderBy("s")
    nxt = lambda c: F.lead(c).over(w)
    seg = vertex.select(*KEY, F.col("s").alias("s0"), F.col("l").alias("l0"), F.col("h_ref").alias("h0"), F.col("slope").alias("k0"),
        F.col("reference").alias("ref0"), F.col("role").alias("r0"), nxt("s").alias("s1"), nxt("l").alias("l1"), nxt("h_ref").alias("h1"),
        nxt("slope").alias("k1"), nxt("reference").alias("ref1"), nxt("role").alias("r1")).where("s1 is not null")
    either = lambda r: (F.col("r0") == r) | (F.col("r1") == r)
    role = F.when(either("extrapolated"), "extrapolated").when(either("gap_interpolation"),
        "gap_interpolation").when(either("attachment_prior"), "attachment_prior").otherwise("between_samples")
    v = Window.partitionBy(*KEY).orderBy("s0")
    length = F.sqrt((F.col("s1") - F.col("s0")) ** 2 + (F.col("l1") - F.col("l0")) ** 2)
    seg = seg.withColumns({"role": role, "length_m": length, "n": F.row_number().over(v), "last": F.lead("s0").over(v).isNull()})
    return seg.withColumn("arc", F.coalesce(F.sum("length_m").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


RELATIONS = "frame_index long, hypothesis string, point_id long, path_s_m double, lateral_m double, vertical_m double, support string, relation string, uncertain_reason string"
#: Of segments equally near the one with the smaller place here is taken.
PREFERENCE = {"between_samples": 1, "gap_interpolation": 2, "attachment_prior": 3, "extrapolated": 4}


def _relations(points: dict, seg: list[dict], vertex: list[dict], lower_m: float | None, profile: Profile, half_m: float) -> dict:
    """Arrays of the results of one hypothesis for the points (arrays s, l and h) of a frame; segments and vertices in order."""
    s, l, h = (points[c] for c in "slh")  # noqa: E741
    n = len(s)
    of = lambda rows, c: np.array([np.nan if r[c] is None else float(r[c]) for r in rows])
    if not seg:
        v = vertex[0]
        k = np.nan_to_num(of([v], "slope")[0])
        up = h - of([v], "h_ref")[0] - (np.nan if lower_m is None else lower_m)
        near = np.abs(s - v["s"]) <= half_m
        lateral = (l - v["l"] + k * up) / np.hypot(1.0, k)
        return {"path_s_m": np.zeros(n), "lateral_m": np.where(np.isfinite(lateral), lateral, l - v["l"]),
            "vertical_m": (up - k * (l - v["l"])) / np.hypot(1.0, k), "support": np.where(near, v["role"], "unsupported"),
            "relation": np.full(n, "uncertain"), "uncertain_reason": np.where(near, "insufficient_direction", "outside_applicability")}
    s0, l0, s1, l1, h0, h1, length, arc = (of(seg, c) for c in ("s0", "l0", "s1", "l1", "h0", "h1", "length_m", "arc"))
    k0, k1 = np.nan_to_num(of(seg, "k0")), np.nan_to_num(of(seg, "k1"))
    ds, dl = s1 - s0, l1 - l0
    raw = ((s[:, None] - s0) * ds + (l[:, None] - l0) * dl) / (length * length)
    t = np.clip(raw, 0.0, 1.0)
    d2 = (s[:, None] - s0 - t * ds) ** 2 + (l[:, None] - l0 - t * dl) ** 2
    role = np.array([r["role"] for r in seg])
    best = (d2 + np.array([PREFERENCE[r] for r in role]) * 1e-12).argmin(1)
    raw, t = raw[np.arange(n), best], t[np.arange(n), best]
    beyond = ((best == 0) & (raw < 0)) | ((best == len(seg) - 1) & (raw > 1))
    foot_s, foot_l = s0[best] + t * ds[best], l0[best] + t * dl[best]
    seen = np.array([v["s"] for v in vertex if v["role"] == "observed"])
    support = role[best].astype(object)
    close = np.abs(foot_s[:, None] - seen).min(1) <= half_m if len(seen) else np.zeros(n, dtype=bool)
    support[close & np.isin(support, ("between_samples", "gap_interpolation"))] = "observed"
    support[beyond] = "unsupported"
    ref = np.array([bool(r["ref0"]) and bool(r["ref1"]) for r in seg])[best]
    base = h0[best] + t * (h1 - h0)[best]
    ref &= np.isfinite(base)
    k = (k0[best] + t * (k1 - k0)[best]) * (ds / length)[best]
    across = (-(s - foot_s) * dl[best] + (l - foot_l) * ds[best]) / length[best]
    up = h - base - (lower_m or 0.0)
    norm = np.hypot(1.0, k)
    lateral, vertical = (across + k * up) / norm, (up - k * across) / norm
    lateral = np.where(np.isfinite(lateral), lateral, across)
    placed = np.isin(support, ("observed", "between_samples")) & (len(seen) >= 2)
    out = placed & (np.abs(lateral) > profile.width_m / 2)
    known = placed & ~out & ref & (lower_m is not None) & np.isfinite(vertical)
    high = (vertical < 0) | (vertical > profile.height_m)
    relation = np.full(n, "uncertain", dtype=object)
    relation[known & ~high] = "inside"
    relation[out | (known & high)] = "outside"
    reason = np.full(n, "lower_boundary_not_established" if lower_m is None else "outside_applicability", dtype=object)
    reason[~ref] = "reference_surface_unsupported"
    if len(seen) < 2:
        reason[:] = "insufficient_direction"
    for name in ("attachment_prior", "gap_interpolation", "extrapolated"):
        reason[support == name] = name
    # beyond the ends, and outside of the stations that the vertices span, nothing is known
    low, far = min(v["s"] for v in vertex), max(v["s"] for v in vertex)
    reason[support == "unsupported"] = "outside_applicability"
    reason[relation != "uncertain"] = None
    start = next((r["arc"] for r in seg if r["r0"] == "observed"), 0.0)
    if seg[0]["r0"] != "observed" and not any(r["r0"] == "observed" for r in seg) and seg[-1]["r1"] == "observed":
        start = seg[-1]["arc"] + seg[-1]["length_m"]
    path = arc[best] + t * length[best] - start
    off = (s < low) | (s > far)
    for x, v in ((path, np.nan), (lateral, np.nan), (vertical, np.nan), (support, "unsupported"), (relation, "uncertain"),
        (reason, "outside_applicability")):
        x[off] = v
    return {"path_s_m": path, "lateral_m": lateral, "vertical_m": vertical, "support": support, "relation": relation, "uncertain_reason": reason}


def paths(seg: DataFrame, vertex: DataFrame) -> DataFrame:
    """One row for each hypothesis (frame_index, hypothesis, vertex, seg), its vertices and segments in order."""
    pieces = seg.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("n", "s0", "l0", "h0", "k0", "ref0", "r0", "s1", "l1", "h1", "k1",
        "ref1", "r1", "role", "length_m", "arc"))).alias("seg"))
    ends = vertex.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("s", "l", "h_ref", "slope", "role"))).alias("vertex"))
    return ends.join(pieces, list(KEY), "left")


def classify(points: DataFrame, seg: DataFrame, vertex: DataFrame, lower_m: float | None = 0.0, profile: Profile = PROFILE,
    half_m: float = GROUND.section_half_m) -> DataFrame:
    """Each point against each hypothesis of its frame: place along, across and above, and the relation.

    Points (frame_index, point_id, s, l, h) meet the few segments and vertices of their frame in one array kernel.
    Outside of the vertices' span a point is unsupported and has no place; a hypothesis of one vertex has no direction.
    """
    found = paths(seg, vertex).select(F.col("frame_index").alias("its_frame"), "hypothesis", "vertex", "seg")
    names = [c.split()[0] for c in RELATIONS.split(", ")]

    def run(pts: pa.Table, its: pa.Table) -> pa.Table:
        own = {c: pts.column(c).to_numpy() for c in ("point_id", "s", "l", "h")}
        out = []
        for p in sorted(its.to_pylist(), key=lambda p: p["hypothesis"]) if pts.num_rows else []:
            got = _relations(own, p["seg"] or [], p["vertex"], lower_m, profile, half_m)
            cols = [pa.array(np.full(len(own["s"]), p["its_frame"])), pa.array([p["hypothesis"]] * len(own["s"])), pa.array(own["point_id"])]
            cols += [pa.array(got[c], pa.float64(), from_pandas=True) for c in names[3:6]] + [pa.array(got[c].tolist(),
                pa.string()) for c in names[6:]]
            out.append(pa.table(dict(zip(names, cols, strict=True))))
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 3, *[pa.string()] * 3]
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    return points.select("frame_index", "point_id", "s", "l",
        "h").groupBy("frame_index").cogroup(found.groupBy("its_frame")).applyInArrow(run, RELATIONS)


def section_at(vertex: DataFrame, at: DataFrame) -> DataFrame:
    """Axis and reference height at query places (frame_index, s_query), between the neighbouring vertices."""
    w = Window.partitionBy(*KEY).orderBy("s")
    pieces = vertex.select(*KEY, "s", "l", "h_ref", F.lead("s").over(w).alias("s1"), F.lead("l").over(w).alias("l1"),
        F.lead("h_ref").over(w).alias("h1")).where("s1 is not null")
    hit = at.join(pieces, "frame_index").where("s_query >= s and s_query < s1")
    t = (F.col("s_query") - F.col("s")) / (F.col("s1") - F.col("s"))
    return hit.select(*KEY, "s_query", (F.col("l") + t * (F.col("l1") - F.col("l"))).alias("l_axis"),
        (F.col("h_ref") + t * (F.col("h1") - F.col("h_ref"))).alias("h_ref"))


def attachment_match(midpoints: DataFrame, place: Attachment) -> DataFrame:
    """How many hypotheses of a frame pass the place that a session was attached at: none, one or several.

    Only sections in the support window count; the heading is checked where it is given and two sections are there.
    """
    inside = midpoints.where(F.col("s").between(place.support_s_min_m - 1e-6, place.support_s_max_m + 1e-6))
    m = inside.groupBy(*KEY).agg(F.min_by("l", F.struct(F.abs(F.col("s") - place.s_m), "s")).alias("l_near"),
        F.min_by("l", "s").alias("l_a"), F.max_by("l", "s").alias("l_b"), (F.max("s") - F.min("s")).alias("ds"), F.count("*").alias("n"))
    ok = F.abs(F.col("l_near") - place.l_m) <= place.lateral_m
    if place.heading is not None and place.heading_tolerance is not None:
        slope = F.when(F.col("ds") == 0, 0.0).otherwise(F.try_divide(F.col("l_b") - F.col("l_a"), "ds"))
        ok &= (F.col("n") < 2) | (F.abs(slope - place.heading) <= place.heading_tolerance)
    found = m.where(ok).groupBy("frame_index").agg(F.count("*").alias("matches"), F.sort_array(F.collect_list("hypothesis")).alias("hypotheses"))
    n = midpoints.select("frame_index").distinct().join(found, "frame_index", "left").fillna(0, ["matches"])
    return n.withColumn("attachment", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("several"))


def object_overlap(object_low: Column, object_high: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(object_high, high) - F.greatest(object_low, low))


def observed_span(vertex: DataFrame) -> DataFrame:
    """From where to where each hypothesis was seen above known ground; hypotheses without such a vertex have no row."""
    seen = vertex.where("role = 'observed' and h_ref is not null")
    return seen.groupBy(*KEY).agg(F.min("s").alias("s_min_m"), F.max("s").alias("s_max_m"))


def support_range(lines: DataFrame) -> DataFrame:
    """From where to where a frame's ground reaches."""
    return lines.groupBy("frame_index").agg(F.min("s_lo").alias("support_s_min_m"), F.max("s_hi").alias("support_s_max_m"))
