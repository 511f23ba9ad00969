"""State that moves by one frame: tracks of candidates, and histories of line pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..config import PAIRS, Pairs

#: The coordinates in which places of two frames can be compared.
SENSOR_FRAME = "sensor_working_prior_mount_unconfirmed"
#: The pose of a sensor that stands where it stood.
STILL = [[float(i == j) for j in range(4)] for i in range(4)]


def moved(position: list[float], then: list[list[float]], now: list[list[float]]) -> np.ndarray:
    """A place (s, l, h) of an earlier frame in the path axes of this one; poses act on sensor axes (l, -s, h)."""
    s, l, h = position  # noqa: E741
    if then == STILL and now == STILL:
        return np.array([s, l, h], dtype=float)
    x, y, z, _ = np.linalg.inv(np.array(now, dtype=float)) @ np.array(then, dtype=float) @ np.array([l, -s, h, 1.0])
    return np.array([-y, x, z])


@dataclass
class Tracker:
    """Tracks of one session.

    A frame seen before changes nothing; another frame of reference clears all. Without a pose, in other
    coordinates than the sensor's, or where the registration is not reliable, tracks only age. Otherwise candidates
    and tracks of one corridor link within ``link_m``, and only where each is the other's only partner; candidates
    without a corridor key never link. A track is confirmed when it was seen in two of its last three frames,
    and dropped when missed too often. Every candidate is published, whatever became of it.
    """

    link_m: float = 0.15
    max_missed: int = 1
    max_age_s: float = 0.5
    need: int = 2
    window: int = 3
    state: dict[str, Any] = field(default_factory=lambda: {"reference": None, "next": 1, "tracks": []})
    #: The frames that were there: a set, or what a stream keeps of them.
    seen: Any = field(default_factory=set)

    def step(self, frame: int, stamp_s: float, candidates: list[dict], reference: str = SENSOR_FRAME, pose: list[list[float]] | None = None,
        reliable: bool = True) -> list[dict]:
        """A row for each candidate, then one for each track without one: track_id, candidate_id, association, count, confirmed."""
        s = self.state
        if frame in self.seen:
            return [self._alone(c, "repeated_frame") for c in candidates]
        self.seen.add(frame)
        if s["reference"] not in (None, reference):
            s["tracks"] = []
        s["reference"] = reference
        if pose is None or reference != SENSOR_FRAME or not reliable:
            self._age(stamp_s)
            why = "no_pose" if pose is None else "other_coordinates" if reference != SENSOR_FRAME else "unreliable"
            return [self._alone(c, why) for c in candidates] + [self._row(t, t["status"]) for t in s["tracks"]]
        by_c: dict[int, set[int]] = {}
        by_t: dict[int, set[int]] = {}
        for t, track in enumerate(s["tracks"]):
            here = moved(track["position"], track["pose"], pose).tolist()
            for c, cand in enumerate(candidates):
                if cand["corridor_key"] and cand["corridor_key"] == track["corridor_key"] and self._near(here, cand["position"]):
                    by_c.setdefault(c, set()).add(t)
                    by_t.setdefault(t, set()).add(c)
        out, used, born = [], set(), []
        for c, cand in enumerate(candidates):
            mine = by_c.get(c, set())
            if not cand["corridor_key"]:
                out.append(self._alone(cand, "no_corridor"))
            elif len(mine) > 1 or any(len(by_t[t]) > 1 for t in mine):
                out.append(self._alone(cand, "ambiguous"))
            elif mine:
                (t,) = mine
                track = s["tracks"][t]
                track |= {"position": list(cand["position"]), "pose": pose, "seen": [*track["seen"], True][-self.window :], "missed": 0,
                    "stamp": stamp_s, "candidate_id": cand["candidate_id"], "status": "active"}
                used.add(t)
                out.append(self._row(track, "linked", cand))
            else:
                track = {"track_id": s["next"], "corridor_key": cand["corridor_key"], "position": list(cand["position"]), "pose": pose,
                    "seen": [True], "missed": 0, "stamp": stamp_s, "candidate_id": cand["candidate_id"], "status": "active"}
                s["next"] += 1
                born.append(track)
                out.append(self._row(track, "new", cand))
        for t, track in enumerate(s["tracks"]):
            if t not in used:
                track |= {"seen": [*track["seen"], False][-self.window - self.max_missed :], "missed": track["missed"] + 1, "status": "missed"}
        rest = [t for t in s["tracks"] if t["missed"] <= self.max_missed]
        s["tracks"] = rest + born
        return out + [self._row(t, "missed") for t in rest if t["status"] == "missed"]

    def _near(self, a: list[float], b: tuple[float, float, float]) -> bool:
        d = math.dist(a, b)
        # plain arithmetic decides but for the border itself, where the last digit counts
        return d <= self.link_m if abs(d - self.link_m) > 1e-9 else bool(np.linalg.norm(np.array(a) - np.array(b)) <= self.link_m)

    def _age(self, stamp_s: float) -> None:
        for t in self.state["tracks"]:
            t |= {"missed": t["missed"] + 1, "status": "missed"}
        self.state["tracks"] = [t for t in self.state["tracks"] if t["missed"] <= self.max_missed and stamp_s - t["stamp"] <= self.max_age_s]

    def _alone(self, cand: dict, why: str) -> dict:
        return {"track_id": None, "candidate_id": cand["candidate_id"], "association": why, "count": 1, "confirmed": False}

    def _row(self, track: dict, association: str, cand: dict | None = None) -> dict:
        n = sum(track["seen"])
        return {"track_id": track["track_id"], "candidate_id": cand["candidate_id"] if cand else None, "association": association,
            "count": n, "confirmed": n >= self.need}


def _tail(values: list[float], window: int) -> float | None:
    return float(np.median(values[-window:])) if values else None


@dataclass
class PairHistories:
    """Histories of the line pairs of one session.

    A pair (left, right, distance, and the slope and place of its midpoint line where that is reliable) belongs to the
    history whose lines are nearest, if no other pair or history is nearly as near. Its width is admitted unless it is
    away from the median of the last ones; outliers in a row that agree with each other are a conflict, which is
    reported and not adopted. Only admitted widths move the lines, the slope and the place. A history without a pair
    pauses; where just one of its lines was seen, the other is assumed in the old distance, which is no measurement.
    """

    cfg: Pairs = PAIRS
    histories: list[dict] = field(default_factory=list)

    def step(self, frame: int, pairs: list[dict], lines: list[float] = (), ground_found: bool = True) -> list[dict]:
        """Rows of this frame: one for each history, new ones included, and for each pair that stays unassigned."""
        cost = sorted((max(abs(p["left"] - h["left"]), abs(p["right"] - h["right"])), i, j) for i, h in enumerate(self.histories) for j,
            p in enumerate(pairs))
        cost = [x for x in cost if x[0] <= self.cfg.match_m]
        torn = [{k for k in {x[1 + side] for x in cost} if len(own := [x[0] for x in cost if x[1 + side] == k]) > 1 and own[1] - own[0] < self.cfg.match_gap_m} for side in (0,
            1)]
        of: dict[int, int] = {}
        for _, i, j in cost:
            if i not in torn[0] and j not in torn[1] and i not in of and j not in of.values():
                of[i] = j
        touched = {j for _, i, j in cost if i in torn[0] or j in torn[1]}
        rows = []
        for i, h in enumerate(self.histories):
            if i in of:
                rows.append(self._measured(h, frame, pairs[of[i]]))
            elif i in torn[0]:
                rows.append(self._row(h, frame, "paused", "ambiguous", raw=_tail([pairs[j]["distance"] for _, k, j in cost if k == i], len(cost))))
            else:
                side, place = self._assumed(h, lines)
                rows.append(self._row(h, frame, "paused", "one_line_seen" if side else "not_seen" if ground_found else "no_ground",
                    assumed_side=side, assumed_l=place))
        for j, p in enumerate(pairs):
            if j in of.values():
                continue
            if j in touched or j in torn[1]:
                rows.append({"pair_id": None, "frame": frame, "update": "paused", "reason": "ambiguous_not_opened", "raw": p["distance"]})
            else:
                h = {"pair_id": len(self.histories) + 1, "left": p["left"], "right": p["right"], "widths": [], "slopes": [], "places": [],
                    "pending": [], "outliers": 0, "conflict": None, "width_frame": None, "place_frame": None}
                self.histories.append(h)
                rows.append(self._measured(h, frame, p))
        return rows

    def _same_lines(self, a: dict, b: dict) -> bool:
        return max(abs(a["left"] - b["left"]), abs(a["right"] - b["right"])) <= self.cfg.match_m

    def _measured(self, h: dict, frame: int, p: dict) -> dict:
        now = _tail(h["widths"], self.cfg.width_window)
        if now is None or len(h["widths"]) < self.cfg.admit_after or abs(p["distance"] - now) <= self.cfg.admit_m:
            h |= {"pending": [], "left": p["left"], "right": p["right"], "width_frame": frame}
            # no more than the medians look at
            h["widths"] = [*h["widths"], p["distance"]][-max(self.cfg.width_window, self.cfg.admit_after) :]
            if p.get("slope") is not None:
                h["slopes"] = [*h["slopes"], p["slope"]][-self.cfg.pose_window :]
            if p.get("place") is not None:
                h["places"] = [*h["places"], p["place"]][-self.cfg.pose_window :]
                h["place_frame"] = frame
            return self._row(h, frame, "accepted", "admitted", raw=p["distance"])
        if h["pending"] and not (abs(p["distance"] - h["pending"][-1]["distance"]) <= self.cfg.admit_m and self._same_lines(p, h["pending"][-1])):
            h["pending"] = []
        if not self._same_lines(p, h):
            h["outliers"] += 1
            return self._row(h, frame, "paused", "other_lines", raw=p["distance"])
        h["pending"] = [*h["pending"], p]
        if len(h["pending"]) >= self.cfg.conflict_run:
            h["conflict"] = _tail([x["distance"] for x in h["pending"]], len(h["pending"]))
            return self._row(h, frame, "width_conflict", "width_conflict", raw=p["distance"])
        h["outliers"] += 1
        return self._row(h, frame, "paused", "outlier", raw=p["distance"])

    def _assumed(self, h: dict, lines: list[float]) -> tuple[str | None, float | None]:
        """The side that was not seen and its assumed place, where only the other one was seen."""
        left, right = ([x for x in lines if abs(x - h[side]) <= self.cfg.match_m] for side in ("left", "right"))
        if bool(left) == bool(right):
            return None, None
        apart = h["right"] - h["left"]
        return ("right", float(np.median(left)) + apart) if left else ("left", float(np.median(right)) - apart)

    def _row(self, h: dict, frame: int, update: str, reason: str, **more) -> dict:
        age = lambda k: None if h[k] is None else frame - h[k]
        return {
            "pair_id": h["pair_id"], "frame": frame, "update": update, "reason": reason, "width": _tail(h["widths"], self.cfg.width_window),
                "width_age": age("width_frame"), "conflict": h["conflict"] if update == "width_conflict" else None,
            "slope": _tail(h["slopes"], self.cfg.pose_window), "place": _tail(h["places"], self.cfg.pose_window),
                "place_age": age("place_frame"), **more,
        }
