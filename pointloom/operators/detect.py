"""From points in a volume to candidates: masks, local planes, components and their extents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DETECTOR, PROFILE, Detector, Profile
from ..session import frame_keyed
from . import spatial


def in_profile(profile: Profile = PROFILE) -> Column:
    """Inside the straight clearance volume, borders included."""
    floor = profile.floor_h_m
    return F.col("s").between(profile.s_min_m,
        profile.s_max_m) & (F.abs(F.col("l") - profile.center_l_m) <= profile.width_m / 2) & F.col("h").between(floor,
        floor + profile.height_m)


def configured_volume(df: DataFrame, profile: Profile = PROFILE) -> DataFrame:
    return df.where(in_profile(profile))


def volume_diagnosis(df: DataFrame, profile: Profile = PROFILE) -> DataFrame:
    """What the volume keeps and what each side cuts."""
    in_s = F.col("s").between(profile.s_min_m, profile.s_max_m)
    return df.groupBy("frame_index").agg(F.count("*").alias("points"), F.count_if(in_s).alias("in_s_only"),
        F.count_if(in_profile(profile)).alias("inside"), F.min(F.when(in_profile(profile), F.col("range_m"))).alias("nearest_m"))


def line_masks(points: DataFrame, samples: DataFrame, cfg: Detector = DETECTOR) -> DataFrame:
    """``excluded``: in the supported volume around a line's sample; ``possible``: in the footprint of one without height support.

    ``samples``: frame_index, s_center, l_median, h_median, width_m, supported; a few for each frame, so they come
    as an array of the frame.
    """
    packed = samples.groupBy("frame_index").agg(F.collect_list(F.struct("s_center", "l_median", "h_median", "width_m", "supported")).alias("samples"))
    foot = lambda x: (F.abs(F.col("s") - x.s_center) <= cfg.line_half_m) & (F.abs(F.col("l") - x.l_median) <= x.width_m / 2)
    hit = F.exists("samples", lambda x: foot(x) & x.supported & (F.abs(F.col("h") - x.h_median) <= cfg.line_height_tol_m))
    maybe = F.exists("samples", lambda x: foot(x) & ~(x.supported & x.h_median.isNotNull()))
    out = points.join(packed, "frame_index", "left").withColumns({"excluded": F.coalesce(hit, F.lit(False)),
            "possible": F.coalesce(maybe, F.lit(False))})
    return out.withColumn("possible", F.col("possible") & ~F.col("excluded")).drop("samples")


def surface_masks(points: DataFrame, residual: DataFrame, cfg: Detector = DETECTOR) -> DataFrame:
    """``explained``: near the ground surface within its residual band; ``ambiguous`` where the band is too wide to tell.

    Needs inside, supported, dh and h; ``residual``: frame_index, p95_m.
    """
    thin = cfg.object_height_m * cfg.object_fraction
    # one row a frame is hashed, so that the points need not be sorted by frame
    out = points.join(residual.select("frame_index", F.col("p95_m").alias("band")).hint("shuffle_hash"), "frame_index", "left")
    mode = F.when(F.col("band").isNull(), "no_fitting_residual").when(F.col("band") >= thin, "ambiguous_not_deleted").otherwise("thin_band_removed")
    used = F.when(F.col("band") >= thin, F.greatest("band", F.lit(cfg.object_height_m))).otherwise(F.col("band"))
    slack = 32 * float(np.finfo(np.float64).eps) * F.greatest(F.lit(1.0), F.abs("h"))
    near = F.coalesce(F.col("inside") & F.col("supported") & F.col("dh").isNotNull() & (F.col("dh") >= -slack), F.lit(False))
    out = out.withColumns({"surface_mode": mode, "used": used, "slack": slack, "near": near})
    return out.withColumns({
        "explained": F.coalesce(F.col("near") & (F.col("surface_mode") == "thin_band_removed") & (F.col("dh") <= F.col("used") + F.col("slack")),
            F.lit(False)),
        "ambiguous": F.coalesce(F.col("near") & (F.col("surface_mode") == "ambiguous_not_deleted") & (F.col("dh") <= F.col("used")), F.lit(False)),
    }).drop("used", "slack", "near", "band")


def object_pool(points: DataFrame) -> DataFrame:
    return points.where("inside and not excluded and not explained and not ambiguous")


def candidates(labelled: DataFrame, branch: str = "volume_or_suspended", cfg: Detector = DETECTOR, large: str = "L", rare: str = "R") -> DataFrame:
    """One row for each component, with extents, nearest range, members and an id by kind.

    Ids count in the order of the component's smallest (s, l, h), which doesn't depend on partitions.
    """
    # one exchange by frame serves the components and their numbering
    c = labelled.repartition("frame_index").groupBy("frame_index", "label").agg(
        F.count("*").alias("unique_xyz"), (F.max("s") - F.min("s")).alias("extent_s_m"), (F.max("l") - F.min("l")).alias("extent_l_m"),
            (F.max("h") - F.min("h")).alias("extent_h_m"),
        F.min("s").alias("s_min_m"), F.min("l").alias("l_min_m"), F.min("h").alias("h_min_m"),
            F.min("range_m").alias("range_from_sensor_m"), F.sort_array(F.collect_list("point_id")).alias("members"),
    )
    c = c.withColumn("kind", F.when(F.col("unique_xyz") >= cfg.large_min, "large").otherwise("rare"))
    n = F.row_number().over(Window.partitionBy("frame_index", "kind").orderBy("s_min_m", "l_min_m", "h_min_m", "label"))
    return c.withColumns({"candidate_id": F.concat(F.when(F.col("kind") == "large", large).otherwise(rare), n.cast("string")),
        "branch": F.lit(branch)})


def dominant_model(rows: DataFrame) -> DataFrame:
    """The most frequent local model of each component, the smallest id on ties."""
    n = rows.groupBy("frame_index", "label", "model_id").agg(F.count("*").alias("n"))
    return n.groupBy("frame_index", "label").agg(F.max_by("model_id", F.struct("n", -F.col("model_id"))).alias("model_id"))


@dataclass(frozen=True)
class Model:
    """A local plane h = a s + b l + c and what became of it; ``reason`` is empty where it can be used."""

    reason: str
    plane: tuple[float, float, float] | None = None
    threshold: float | None = None
    #: Where its support lies, if points outside may not ask it: (s_min, s_max, l_min, l_max).
    extent: tuple[float, float, float, float] | None = None


def _plane(a: np.ndarray) -> np.ndarray:
    x = np.ones((len(a), 3))
    x[:, :2] = a[:, :2]
    return np.linalg.lstsq(x, a[:, 2], rcond=None)[0]


def _quantile(a: np.ndarray, q: float) -> float:
    """``np.quantile`` of a few finite values, without what it does for other shapes and methods."""
    a, at = np.sort(a), q * (len(a) - 1)
    k = int(at)
    if k + 1 >= len(a):
        return float(a[-1])
    t, gap = at - k, a[k + 1] - a[k]
    return float(a[k + 1] - gap * (1 - t) if t >= 0.5 else a[k] + gap * t)


def _middle(values: list[float]) -> float:
    """The median of a few values."""
    values.sort()
    k = len(values) // 2
    return values[k] if len(values) % 2 else (values[k - 1] + values[k]) / 2


def _off(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.abs(a[:, 2] - a[:, :2] @ c[:2] - c[2])


def _checked(fitted: np.ndarray, held: np.ndarray, cfg: Detector) -> tuple[str, np.ndarray | None, float, float]:
    """A plane by least squares on some rows, and the 95th percentiles of residuals on them and on rows held out."""
    if len(fitted) < cfg.fit_min or len(held) < cfg.holdout_min:
        return "too_few_held_out", None, 0.0, 0.0
    c = _plane(fitted)
    return "", c, _quantile(_off(fitted, c), 0.95), _quantile(_off(held, c), 0.95)


def _lower_plane(a: np.ndarray, fit: str, cfg: Detector) -> Model:
    """The plane of a neighbourhood's lower rows, unless it has two levels; every second row is held out."""
    half, h = max(4, cfg.min_support // 2), np.sort(a[:, 2])
    cuts = np.flatnonzero(np.diff(h) > cfg.level_gap_m) + 1
    if ((cuts >= half) & (cuts <= len(h) - half)).any():
        return Model("several_levels")
    low = a[a[:, 2] <= _quantile(h, cfg.lower_fraction)]
    return _halved_plane(low[np.lexsort((low[:, 1], low[:, 0]))], fit, cfg)


def _halved_plane(low: np.ndarray, fit: str, cfg: Detector) -> Model:
    """The plane of the lower rows in the order of (s, l)."""
    if fit == "span_limit" and np.ptp(low[:, 2]) > cfg.level_gap_m:
        return Model("support_too_high")
    reason, c, fit_p95, held_p95 = _checked(low[0::2], low[1::2], cfg)
    if not reason and held_p95 > cfg.unstable_ratio * max(fit_p95, 1e-4):
        reason = "unstable"
    return Model(reason) if reason else Model("", tuple(c.tolist()), held_p95)


def _consensus(a: np.ndarray, seed: int, tries: int, cfg: Detector) -> tuple[np.ndarray | None, np.ndarray]:
    """Of planes through random triples, none too steep, the one with most rows near it, and those rows."""
    draw, best, near = np.random.default_rng(seed), None, np.zeros(len(a), dtype=bool)
    for _ in range(tries):
        t = a[draw.choice(len(a), 3, replace=False)]
        (s0, l0), (s1, l1), (s2, l2) = t[:, :2]
        if abs((s1 - s0) * (l2 - l0) - (s2 - s0) * (l1 - l0)) < 2e-6:
            continue
        c = _plane(t)
        if np.hypot(c[0], c[1]) <= cfg.steepest and (m := _off(a, c) <= cfg.level_gap_m).sum() > near.sum():
            best, near = c, m
    return (best, near) if near.sum() >= cfg.min_support else (None, near)


def _drawn_plane(a: np.ndarray, cfg: Detector) -> Model:
    """The plane by consensus of random triples, if the rows that it leaves have no second one at another height."""
    best, near = _consensus(a, cfg.seed, cfg.tries, cfg)
    if best is None:
        return Model("no_plane")
    own = a[near]
    if min(np.ptp(own[:, 0]), np.ptp(own[:, 1])) < cfg.link_m:
        return Model("narrow_line")
    own = own[np.lexsort((own[:, 1], own[:, 0]))]
    reason, c, _, held_p95 = _checked(own[: len(own) // 2], own[len(own) // 2 :], cfg)
    if not reason and np.hypot(c[0], c[1]) > cfg.steepest:
        reason = "too_steep"
    if not reason and held_p95 > cfg.level_gap_m:
        reason = "held_out_rows_disagree"
    if not reason and (~near).sum() >= cfg.min_support:
        second, _ = _consensus(a[~near], cfg.seed + 1, cfg.tries // 2, cfg)
        middle = np.array([np.median(a[:, 0]), np.median(a[:, 1]), 1.0])
        if second is not None and abs(float((second - c) @ middle)) > cfg.level_gap_m:
            reason = "several_supports"
    return Model(reason) if reason else Model("", tuple(c.tolist()), held_p95, (own[:, 0].min(), own[:, 0].max(), own[:, 1].min(), own[:, 1].max()))


class Support:
    """All points of a frame by cells of (s, l), built once and asked for the rows around any place."""

    def __init__(self, a: np.ndarray, step: float):
        order = np.lexsort((a[:, 2], a[:, 1], a[:, 0]))
        self.step, self.rows = step, a[order]
        self.s, self.l, self.first = self.rows[:, 0].copy(), self.rows[:, 1].copy(), np.floor(self.rows[:, 0] / step).astype(np.int64)

    def within(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) for the rows within the radius of each place, by place and in the order of rows: that of (s, l, h)."""
        lo = self.first.searchsorted(np.floor((at[:, 0].min() - radius) / self.step))
        hi = self.first.searchsorted(np.floor((at[:, 0].max() + radius) / self.step), side="right")
        own, row = np.nonzero((self.s[None, lo:hi] - at[:, 0, None]) ** 2 + (self.l[None, lo:hi] - at[:, 1, None]) ** 2 <= radius * radius)
        return own, row + lo

    def around(self, at: np.ndarray, radius: float) -> np.ndarray:
        """Rows within the radius in the order of (h, s, l)."""
        part = self.rows[self.within(at[None, :], radius)[1]]
        return part[part[:, 2].argsort(kind="stable")]


def _lower_planes(support: Support, at: np.ndarray, radius: float, fit: str, cfg: Detector) -> list[Model]:
    """``local_model`` around many places: all neighbourhoods are found, counted, cut and halved at once, only their planes are fitted one by one."""
    out = [Model("too_few_points")] * len(at)
    own, row = support.within(at, radius)
    n = np.bincount(own, minlength=len(at))
    full = n[own] >= cfg.min_support
    own, row = own[full], row[full]
    if not len(own):
        return out
    n, h = np.where(n >= cfg.min_support, n, 0), support.rows[row, 2]
    start, order, half = np.cumsum(n) - n, np.lexsort((h, own)), max(4, cfg.min_support // 2)
    place, sorted_h = own[order], h[order]
    cut = np.arange(1, len(own)) - start[place[1:]]  # rows below each step to the next height
    apart = (np.diff(sorted_h) > cfg.level_gap_m) & (cut >= half) & (cut <= n[place[1:]] - half)
    levels = np.zeros(len(at), dtype=bool)
    levels[place[1:][apart]] = True
    used = np.flatnonzero(n)
    share = cfg.lower_fraction * (n[used] - 1)  # as ``_quantile`` has it
    k = share.astype(np.int64)
    below, above, t = sorted_h[start[used] + k], sorted_h[start[used] + np.minimum(k + 1, n[used] - 1)], share - k
    limit = np.zeros(len(at))
    limit[used] = np.where(t >= 0.5, above - (above - below) * (1 - t), below + (above - below) * t)
    low = h <= limit[own]
    rows, ends = support.rows[row[low]], np.cumsum(np.bincount(own[low], minlength=len(at))).tolist()
    for p in used.tolist():
        out[p] = Model("several_levels") if levels[p] else _halved_plane(rows[ends[p - 1] if p else 0 : ends[p]], fit, cfg)
    return out


def _models(support: Support, at: np.ndarray, radius: float, fit: str, cfg: Detector) -> list[Model]:
    """The model of the rows around each place."""
    if fit == "ransac":
        return [local_model(support.around(x, radius), fit, cfg) for x in at]
    many = max(1, 2_000_000 // max(1, len(support.rows)))
    return [m for k in range(0, len(at), many) for m in _lower_planes(support, at[k : k + many], radius, fit, cfg)]


def local_model(a: np.ndarray, fit: str = "baseline", cfg: Detector = DETECTOR) -> Model:
    """The model of the rows (s, l, h) around an anchor; ``fit``: baseline, span_limit or ransac."""
    if len(a) < cfg.min_support:
        return Model("too_few_points")
    return _drawn_plane(a, cfg) if fit == "ransac" else _lower_plane(a, fit, cfg)


PROTRUSIONS = "frame_index long, point_id long, accepted boolean, reason string, radius_m double, model_id int, deviation_m double, threshold_m double"


def _protrusions(q: np.ndarray, support: Support, fit: str, cfg: Detector) -> list[tuple]:
    """(accepted, reason, radius, model, deviation, threshold) for each row of q against planes through rows of the frame."""
    cells: dict[tuple, list[int]] = {}
    for k, c in enumerate(map(tuple, np.floor(q[:, :2] / cfg.anchor_step_m).astype(int).tolist())):
        cells.setdefault(c, []).append(k)  # anchors in the order in which their cells are first met
    places = q.tolist()
    anchor = np.array([[_middle([places[k][c] for k in rows]) for c in (0, 1)] for rows in cells.values()])
    out: list = [(False, "no_local_model", None, None, None, None)] * len(q)
    nearest, gap = [], []  # of each row, whatever the radius
    for at in np.array_split(q, 1 + len(q) * len(anchor) // 2_000_000):
        d = np.hypot(at[:, 0, None] - anchor[:, 0], at[:, 1, None] - anchor[:, 1])
        nearest += d.argmin(1).tolist()
        gap += d.min(1).tolist()
    left = range(len(q))
    for r, radius in enumerate(cfg.radii_m):
        need = sorted({nearest[k] for k in left if gap[k] <= radius})
        models = dict(zip(need, _models(support, anchor[need], radius, fit, cfg), strict=True)) if need else {}
        still = []
        for k in left:
            if gap[k] > radius:
                still.append(k)
                continue
            n = nearest[k]
            m, (s, l, h) = models[n], places[k]  # noqa: E741
            outside = m.extent is not None and not (m.extent[0] <= s <= m.extent[1] and m.extent[2] <= l <= m.extent[3])
            if m.reason or outside:
                out[k] = (False, m.reason or "outside_of_support", None, None, None, None)
                still.append(k)
                continue
            off = h - s * m.plane[0] - l * m.plane[1] - m.plane[2]
            accepted = off > m.threshold and off > 0
            out[k] = (accepted, "above_threshold" if accepted else "within_held_out_spread", radius, r * len(anchor) + n, off, m.threshold)
        left = still
        if not left:
            break
    return out


def local_protrusions(queries: DataFrame, points: DataFrame, fit: str = "baseline", context: DataFrame | None = None,
    cfg: Detector = DETECTOR) -> DataFrame:
    """Query points (frame_index, point_id, s, l, h) with ``accepted``, reason and model, by growing radii.

    Anchors are the medians of the queries in cells; a point asks the nearest anchor within the radius; a usable model
    decides, an unusable one, or none in reach, hands the point on to the next radius. All ``points`` of the frame,
    and those of ``context`` (more rows of other scans, never queries), can support a plane. One kernel for each frame.
    """
    rows = points.select("frame_index", "s", "l", "h")
    rows = rows if context is None else rows.unionByName(context.select("frame_index", "s", "l", "h"))
    rows = rows.join(queries.select("frame_index").distinct(), "frame_index", "left_semi")  # no other frame's points are sent to Python
    rows = rows.select(F.col("frame_index").alias("its_frame"), F.col("s").alias("s0"), F.col("l").alias("l0"), F.col("h").alias("h0"))
    names = [c.split()[0] for c in PROTRUSIONS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]

    def run(asked: pa.Table, every: pa.Table) -> pa.Table:
        asked = asked.take(np.argsort(asked.column("point_id").to_numpy()))
        read = lambda t, cols: np.column_stack([t.column(c).to_numpy() for c in cols])
        found = _protrusions(read(asked, "slh"), Support(read(every, ("s0", "l0", "h0")), cfg.anchor_step_m), fit, cfg) if asked.num_rows else []
        cols = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 6
        data = [asked.column("frame_index"), asked.column("point_id"), *cols]
        return pa.table({n: pa.chunked_array(x) if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for n, t,
            x in zip(names, kinds, data, strict=True)})

    return queries.select("frame_index", "point_id", "s", "l",
        "h").groupBy("frame_index").cogroup(rows.groupBy("its_frame")).applyInArrow(run, PROTRUSIONS)


def straight_candidates(
    marked: DataFrame, fit: str = "baseline", protrusions: bool = True, by_distance: bool = True, cfg: Detector = DETECTOR,
    points: DataFrame | None = None,
) -> DataFrame:
    """All candidates of a volume: components of the pool (L, R), and of the local protrusions in the ambiguous layer (P, Q).

    ``by_distance`` and ``protrusions`` are the two choices of a variant; without the first, occupied cells that touch are linked.
    ``points``: all points of the frames without masks, where they are at hand; they can support planes. Of the marked ones only
    what is inside and unexplained is stored, once, for the pool and for the layer.
    """
    used = ["frame_index", "point_id", "s", "l", "h", "range_m"]  # no more of a point goes through the kernels
    left = marked.where("inside and not excluded and not explained").select(*used, "ambiguous")
    left = frame_keyed(left, dealt=True) if protrusions else left
    pool = left.where("not ambiguous").select(*used).withColumn("radius", spatial.link_radius(cfg))
    found = candidates(spatial.components(pool) if by_distance else spatial.cell_components(pool, cfg.cell_gap_m), cfg=cfg)
    if not protrusions:
        return found.withColumn("model_id", F.lit(None).cast("int"))
    asked = left.where("ambiguous")
    up = local_protrusions(asked, marked if points is None else points, fit, cfg=cfg).where("accepted").select("frame_index", "point_id", "model_id")
    rows = spatial.components(asked.select(*used).join(up, ["frame_index", "point_id"]).withColumn("radius", spatial.link_radius(cfg)))
    bumps = candidates(rows, "local_protrusion", cfg, "P", "Q").join(dominant_model(rows), ["frame_index", "label"], "left")
    return found.withColumn("model_id", F.lit(None).cast("int")).unionByName(bumps)
