"""Detection along inferred corridors: a frame's points are held once and serve all of its hypotheses.

A frame has a few hypotheses (pairs of lines); each has a corridor of its own, lines of its own to leave out and, with that, candidates of
its own. One kernel a frame gets the points once, sorted along the track, and the hypotheses as rows with their corridor. For each it
looks at the stretch of points that the corridor spans, and gives back a row with the funnel and the candidates. So a
point is shuffled once, however many hypotheses there are, and planes of all hypotheses ask one index of the frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import DETECTOR, GROUND, PROFILE, Detector, Ground, Profile
from . import corridor
from .detect import Support, _protrusions
from .pairs import line_samples
from .spatial import _labels

_NUMBERS = ("extent_s_m", "extent_l_m", "extent_h_m", "s_min_m", "l_min_m", "h_min_m", "range_from_sensor_m")
_STAGES = ("points", "in_volume", "off_lines", "off_surface", "in_pool", "in_layer", "protruding")
_CANDIDATE = pa.struct([("candidate_id", pa.string()), ("kind", pa.string()), ("branch", pa.string()), ("label", pa.int64()), ("unique_xyz", pa.int64()),
    *[(n, pa.float64()) for n in _NUMBERS], ("model_id", pa.int32()), ("members", pa.list_(pa.int64()))])
_CANDIDATE_SQL = "array<struct<candidate_id:string,kind:string,branch:string,label:bigint,unique_xyz:bigint," + ",".join(f"{n}:double" for n in _NUMBERS) + ",model_id:int,members:array<bigint>>>"
DETECTED = "frame_index long, hypothesis string, surface_mode string, " + ", ".join(f"{n} long" for n in _STAGES) + f", candidates {_CANDIDATE_SQL}"
_TYPES = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(_STAGES), pa.list_(_CANDIDATE)]


def _components(p: dict, at: np.ndarray, model: np.ndarray | None, branch: str, letters: str, cfg: Detector) -> list[dict]:
    """Candidates of the points at ``at`` (in the order of their ids), numbered by kind in the order of (s, l, h)."""
    if not len(at):
        return []
    xyz = np.column_stack([p[c][at] for c in "slh"])
    far = np.sqrt((xyz * xyz).sum(1)) >= cfg.far_range_m
    label = _labels(xyz, np.where(far, max(cfg.link_m, cfg.far_link_m), cfg.link_m))
    out = []
    for first in np.unique(label):
        k = np.flatnonzero(label == first)
        low, size = xyz[k].min(0), xyz[k].max(0) - xyz[k].min(0)
        numbers = dict(zip(_NUMBERS, [*size.tolist(), *low.tolist(), float(p["range_m"][at[k]].min())], strict=True))
        votes = None
        if model is not None:
            ids, n = np.unique(model[k], return_counts=True)
            votes = int(ids[n.argmax()])  # the most frequent, the smallest on ties
        out.append({"kind": "large" if len(k) >= cfg.large_min else "rare", "branch": branch, "label": int(p["point_id"][at[first]]), "unique_xyz": len(k),
            "model_id": votes, "members": p["point_id"][at[k]].tolist()} | numbers)
    out.sort(key=lambda c: (c["s_min_m"], c["l_min_m"], c["h_min_m"], c["label"]))
    for kind, letter in zip(("large", "rare"), letters, strict=True):
        for n, c in enumerate((c for c in out if c["kind"] == kind), 1):
            c["candidate_id"] = f"{letter}{n}"
    return out


def _on_lines(s: np.ndarray, l: np.ndarray, h: np.ndarray, samples: list[dict], cfg: Detector) -> np.ndarray:  # noqa: E741
    """Points in the supported volume around a sample of the hypothesis' own lines."""
    out = np.zeros(len(s), dtype=bool)
    for x in samples:
        if x["supported"] and x["h_median"] is not None:
            out |= (np.abs(s - x["s_center"]) <= cfg.line_half_m) & (np.abs(l - x["l_median"]) <= x["width_m"] / 2) & (np.abs(h - x["h_median"]) <= cfg.line_height_tol_m)
    return out


def _detected(p: dict, path: dict, support: Support, fit: str, protrusions: bool, lower_m: float | None, profile: Profile, half_m: float, cfg: Detector) -> dict:
    """Funnel and candidates of one hypothesis; ``p``: arrays of the frame in the order of s."""
    ends = [v["s"] for v in path["vertex"]]
    a, b = np.searchsorted(p["s"], min(ends)), np.searchsorted(p["s"], max(ends), side="right")
    near = {c: x[a:b] for c, x in p.items()}
    inside = corridor._relations(near, path["seg"] or [], path["vertex"], lower_m, profile, half_m)["relation"] == "inside" if b > a else np.zeros(0, dtype=bool)
    free = inside & ~_on_lines(near["s"], near["l"], near["h"], path["samples"] or [], cfg)
    band, thin = path["band"], cfg.object_height_m * cfg.object_fraction
    mode = "no_fitting_residual" if band is None else "ambiguous_not_deleted" if band >= thin else "thin_band_removed"
    slack = 32 * np.finfo(np.float64).eps * np.maximum(1.0, np.abs(near["h"]))
    with np.errstate(invalid="ignore"):
        close = inside & near["supported"] & (near["dh"] >= -slack)
        explained = close & (near["dh"] <= band + slack) if mode == "thin_band_removed" else np.zeros(b - a, dtype=bool)
        layer = close & (near["dh"] <= max(band, cfg.object_height_m)) if mode == "ambiguous_not_deleted" else np.zeros(b - a, dtype=bool)
    by_id = lambda mask: (k := np.flatnonzero(mask))[np.argsort(near["point_id"][k])]
    pool, asked = by_id(free & ~explained & ~layer), by_id(free & layer)
    found, up = _components(near, pool, None, "volume_or_suspended", "LR", cfg), np.zeros(0, dtype=np.int64)
    if protrusions and len(asked):
        told = _protrusions(np.column_stack([near[c][asked] for c in "slh"]), support, fit, cfg)
        yes = np.array([t[0] for t in told])
        up = asked[yes]
        found += _components(near, up, np.array([t[3] for t in told if t[0]]), "local_protrusion", "PQ", cfg)
    counts = (len(p["s"]), inside.sum(), free.sum(), (free & ~explained).sum(), len(pool), len(asked), len(up))
    return {"surface_mode": mode, "candidates": found} | dict(zip(_STAGES, map(int, counts), strict=True))


def detect(points: DataFrame, paths: DataFrame, fit: str = "baseline", protrusions: bool = True, lower_m: float | None = 0.0, profile: Profile = PROFILE,
    half_m: float = GROUND.section_half_m, cfg: Detector = DETECTOR) -> DataFrame:
    """A row for each hypothesis (DETECTED): points left after each mask, and its candidates with their members.

    ``points``: frame_index, point_id, s, l, h, range_m, dh, supported; ``paths``: frame_index, hypothesis, vertex, seg (as ``corridor.paths`` gives
    them), samples of the hypothesis' own lines, and the band of the frame's residual.
    """
    names = [c.split()[0] for c in DETECTED.split(", ")[: 3 + len(_STAGES)]] + ["candidates"]
    columns = ("point_id", "s", "l", "h", "range_m", "dh", "supported")

    def run(pts: pa.Table, its: pa.Table) -> pa.Table:
        rows = []
        if pts.num_rows and its.num_rows:
            p = {c: pts.column(c).to_numpy(zero_copy_only=False) for c in columns}
            p["supported"], p["dh"] = p["supported"].astype(bool), p["dh"].astype(np.float64)
            order = np.lexsort((p["point_id"], p["s"]))
            p = {c: x[order] for c, x in p.items()}
            support = Support(np.column_stack([p[c] for c in "slh"]), cfg.anchor_step_m)
            for path in sorted(its.to_pylist(), key=lambda x: x["hypothesis"]):
                rows.append({"frame_index": path["its_frame"], "hypothesis": path["hypothesis"]} | _detected(p, path, support, fit, protrusions, lower_m, profile, half_m, cfg))
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES, strict=True)})

    keyed = paths.withColumnRenamed("frame_index", "its_frame").select("its_frame", "hypothesis", "vertex", "seg", "samples", "band")
    return points.select("frame_index", *columns).groupBy("frame_index").cogroup(keyed.groupBy("its_frame")).applyInArrow(run, DETECTED)


def paths_of(midpoints: DataFrame, pair_of: DataFrame, fragments: DataFrame, lines: DataFrame, residual: DataFrame, cfg: Ground = GROUND,
    prior: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths for ``detect``, vertices): corridors along the midpoints (frame_index, hypothesis, s, l) with what each hypothesis needs.

    ``pair_of``: frame_index, hypothesis, a_track, b_track; ``prior``: the place (s, l) that a session is attached to. All of it has a few rows a frame.
    """
    key = list(corridor.KEY)
    vertex = corridor.vertices(midpoints, lines, prior, cfg)
    own = line_samples(pair_of, fragments, lines, cfg).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("s_center", "l_median", "h_median", "width_m", "supported"))).alias("samples"))
    band = residual.select("frame_index", F.col("p95_m").alias("band"))
    return corridor.paths(corridor.segments(vertex), vertex).join(own, key, "left").join(band, "frame_index", "left"), vertex


def hypotheses(scored: DataFrame, vertex: DataFrame, attachment: DataFrame | None = None) -> DataFrame:
    """What is known of each hypothesis before points are looked at: kind, score, observed span, whether it can be used.

    ``scored``: frame_index, hypothesis, kind, score, penalties; ``attachment``: the matches of ``corridor.attachment_match`` where a session is attached
    to a place. ``geometry_applicable`` is null for a hypothesis that the attachment excludes, as nothing is built for it.
    """
    out = scored.join(corridor.observed_span(vertex), list(corridor.KEY), "left")
    fits = F.lit(True)
    if attachment is not None:
        out = out.join(attachment.select("frame_index", F.col("hypotheses").alias("fit")), "frame_index", "left")
        fits = F.coalesce(F.array_contains("fit", F.col("hypothesis")), F.lit(False))
    out = out.withColumn("attachment_compatible", fits)
    span = F.when(F.col("attachment_compatible"), F.col("s_min_m").isNotNull())
    return out.select("frame_index", "hypothesis", "kind", "score", "penalties", "attachment_compatible", span.alias("geometry_applicable"),
        F.when(span, F.col("s_min_m")).alias("observed_s_min_m"), F.when(span, F.col("s_max_m")).alias("observed_s_max_m"))


def usable(known: DataFrame) -> DataFrame:
    """The hypotheses that points are looked at for."""
    return known.where("geometry_applicable").select(*corridor.KEY)


def candidates(detected: DataFrame) -> DataFrame:
    """One row for each candidate of each hypothesis; their sum over hypotheses is no number of objects."""
    return detected.select("frame_index", "hypothesis", F.explode("candidates").alias("c")).select("frame_index", "hypothesis", "c.*")


def counted(known: DataFrame, detected: DataFrame) -> DataFrame:
    """Every hypothesis with its funnel and its candidates by branch and kind; zeros where nothing was looked at."""
    n = lambda branch, kind: F.size(F.filter("candidates", lambda c: (c.branch == branch) & (c.kind == kind))).cast("long")
    kinds = {"volume_large": n("volume_or_suspended", "large"), "volume_rare": n("volume_or_suspended", "rare"),
        "protrusion_large": n("local_protrusion", "large"), "protrusion_rare": n("local_protrusion", "rare")}
    found = detected.withColumns(kinds).drop("candidates").withColumn("detected", F.lit(True))
    return known.join(found, list(corridor.KEY), "left").fillna(0, [*_STAGES, *kinds]).fillna(False, ["detected"])


def frame_statuses(frames: DataFrame, known: DataFrame, attached: bool = False) -> DataFrame:
    """One row for each frame (frame_index, ground_found) with its status and numbers of hypotheses.

    Without a ground there is insufficient geometry; without hypotheses none, or a conflict where a session is attached; the
    same conflict where none is compatible; insufficient geometry where no compatible one was seen above known ground.
    """
    n = known.groupBy("frame_index").agg(F.count(F.lit(1)).alias("hypotheses"), F.count_if("attachment_compatible").alias("compatible"),
        F.count_if("geometry_applicable").alias("applicable"))
    out = frames.join(n, "frame_index", "left").fillna(0, ["hypotheses", "compatible", "applicable"])
    conflict = F.lit("attachment_conflict")
    status = (
        F.when(~F.col("ground_found"), "insufficient_geometry")
        .when(F.col("hypotheses") == 0, conflict if attached else F.lit("no_hypotheses"))
        .when(F.lit(attached) & (F.col("compatible") == 0), conflict)
        .when(F.col("applicable") == 0, "insufficient_geometry")
        .otherwise("ok")
    )
    return out.withColumns({"status": status, "corridor_source": F.lit("inferred")})
