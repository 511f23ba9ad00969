"""Settings as files: profile, rule, session, variants, roles of recordings, frames to view.

Files are read by Spark, so they may lie in any store that it reaches; what comes out are the
dataclasses of ``config`` and small tables.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from ..config import AXIS, DETECTOR, PROFILE, Attachment, Axis, Detector, Profile
from ..operators.cloud import Mount


def load(spark: SparkSession, path: str) -> dict:
    """A settings file as a mapping."""
    import yaml

    rows = spark.read.text(path, wholetext=True).select("value").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    found = yaml.safe_load(rows[0].value)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


def profile(settings: dict) -> tuple[Profile, Axis]:
    """The straight clearance profile and the tolerances that a track is held against."""
    shape, along, axis = settings["profile"], settings["longitudinal"], settings["axis_check"]
    p = replace(
        PROFILE, width_m=float(shape["width_m"]), height_m=float(shape["height_m"]), center_l_m=float(shape["center_l_m"]),
            floor_offset_m=float(shape["lower_boundary_above_rail_head_m"]),
        rail_head_h_m=float(settings["prior"]["rail_head_h_if_z_up_and_angles_zero_m"]), s_min_m=float(along["s_min_m"]),
            s_max_m=float(along["s_max_m"]), far_from_m=float(along["far_assumption_from_s_m"]),
    )
    return p, replace(AXIS, heading=float(axis["heading_tolerance_dl_ds"]), min_span_m=float(axis["min_support_span_m"]))


def attachments(settings: dict) -> dict[str, Attachment]:
    """The enabled places that a session may be attached at, by name; a session never names the own path."""
    if settings.get("own_path_assigned") or any(v.get("own_path") for v in settings["variants"]):
        raise ValueError("a session must not name the own path")
    m = settings["match"]
    return {
        v["name"]: Attachment(float(v["s_m"]), float(v["l_m"]), float(m["support_s_min_m"]), float(m["support_s_max_m"]),
            float(m["lateral_tolerance_m"]), m.get("heading_dl_ds"), m.get("heading_tolerance"))
        for v in settings["variants"]
        if v.get("enabled")
    }


def mount(settings: dict) -> Mount:
    """Where the sensor sits; it is applied only if it is confirmed."""
    m = settings["mount"]
    t, a = m["translation_m"], m["rpy_rad"]
    return Mount(float(t["x"]), float(t["y"]), float(t["z"]), float(a["roll"]), float(a["pitch"]), float(a["yaw"]), bool(m["confirmed"]),
        m.get("source") or "", m.get("basis") or "")


@dataclass(frozen=True)
class Variant:
    name: str
    by_distance: bool
    protrusions: bool


def variant(settings: dict, name: str | None = None) -> Variant:
    """One of the frozen ways to detect: links by distance or by cells, with local protrusions or without."""
    name = name or settings.get("default_variant")
    block = (settings.get("variants") or {}).get(name)
    if not isinstance(block, dict) or block.get("connectivity") not in ("cells", "distance"):
        raise ValueError(f"variant {name} is not defined, or links by something unknown")
    return Variant(name, block["connectivity"] == "distance", bool(block.get("local_protrusions")))


#: Settings of the detector by the names that files use.
DETECTOR_NAMES = {
    "comparable_object_height_m": "object_height_m", "surface_comparable_fraction": "object_fraction",
        "structure_height_tolerance_m": "line_height_tol_m", "cluster_gap_m": "cell_gap_m",
    "link_distance_m": "link_m", "large_min_unique_xyz": "large_min", "local_radius_m": "radii_m", "local_anchor_step_m": "anchor_step_m",
        "local_min_support": "min_support", "local_lower_fraction": "lower_fraction",
    "local_level_gap_m": "level_gap_m", "local_unstable_ratio": "unstable_ratio", "local_fit_min": "fit_min", "local_holdout_min": "holdout_min",
}


def detector(settings: dict) -> Detector:
    """The detector's numbers; blocks give theirs as ``value``, what a file lacks keeps its default."""
    kinds = {f.name: type(getattr(DETECTOR, f.name)) for f in fields(Detector)}
    given = {}
    for name, own in DETECTOR_NAMES.items():
        if name in settings:
            x = settings[name]["value"] if isinstance(settings[name], dict) else settings[name]
            given[own] = tuple(map(float, x)) if kinds[own] is tuple else kinds[own](x)
    return replace(DETECTOR, **given)


def roles(spark: SparkSession, settings: dict) -> DataFrame:
    """The split of the recordings: run, role."""
    return spark.createDataFrame([(run, role) for role, runs in (settings.get("split") or {}).items() for run in runs or []],
        "run string, role string")


def view_frames(spark: SparkSession, settings: dict) -> DataFrame:
    """Frames that were chosen to be looked at: run, message_index."""
    rows = [(x.get("run"), x.get("message_index")) for x in settings.get("view_frames") or []]
    if any(run is None or index is None for run, index in rows):
        raise ValueError("a frame to view needs a run and an index")
    return spark.createDataFrame([(run, int(index)) for run, index in rows], "run string, message_index long")


def parameters(spark: SparkSession, *settings) -> DataFrame:
    """Every number of some dataclasses, as a table: group, name, value."""
    return spark.createDataFrame([(type(s).__name__.lower(), f.name, str(getattr(s, f.name))) for s in settings for f in fields(s)],
        "group string, name string, value string")
