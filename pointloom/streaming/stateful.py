"""Tracking and pair histories as stateful streams: typed state in RocksDB for each session, frame keys that expire by timers.

A session's state lives with its key wherever the store's partition is, is checkpointed with the stream, and moves on by the frames of a micro-batch;
no session is ever read whole. What a micro-batch brings of one session is taken in the order of its frames. Frames have to come in
order from batch to batch, as a recording or a sensor gives them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .replay import HISTORY_ROWS, TRACK_ROWS, posed, tracked
from .tracker import PairHistories, Tracker

#: The state store that these operators need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK = "track_id int, corridor_key string, s double, l double, h double, pose array<double>, seen array<boolean>, missed int, stamp double, candidate_id string, status string"
HISTORY = "left double, right double, widths array<double>, slopes array<double>, places array<double>, pending_distance array<double>, pending_left array<double>, pending_right array<double>, outliers int, conflict double, width_frame long, place_frame long"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The session's state store is RocksDB inside of the block; a stream has to be started there."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _frame(rows: list[tuple], schema: str, whole: tuple[str, ...] = ()) -> pd.DataFrame:
    """Rows as pandas, with nullable integers where some are missing."""
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c: "Int64" for c in whole})


class _Seen:
    """The frames of a session that are known, as the tracker asks for them: kept until the timer of their time."""

    def __init__(self, processor: Tracks, times: dict[int, int]):
        self.p, self.times = processor, times

    def __contains__(self, frame: int) -> bool:
        return self.p.seen.containsKey((frame,))

    def add(self, frame: int) -> None:
        at = self.times[frame]
        self.p.seen.updateValue((frame,), (at,))
        due = self.p.due.getValue((at,))[0] if self.p.due.containsKey((at,)) else []
        self.p.due.updateValue((at,), ([*due, frame],))
        self.p.handle.registerTimer(at)


class Tracks(StatefulProcessor):
    """``Tracker`` with its tracks as a list, its counter as a value and its frame keys as a map with timers.

    A frame can only come again until the watermark passes its time, as later rows are late and dropped by the engine. That
    is when its key's timer fires and the key goes, so the state is as large as the watermark's delay, not as the session.
    """

    def __init__(self, **given):
        self.given = given

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "reference string, next int")
        self.tracks = handle.getListState("tracks", TRACK)
        self.seen = handle.getMapState("seen", "frame long", "at long")
        self.due = handle.getMapState("due", "at long", "frames array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        t = Tracker(**self.given)
        times = dict(zip(pdf["frame"].astype(int), (pdf["ts"].astype("datetime64[ms]").astype("int64")).astype(int), strict=True))
        t.seen = _Seen(self, times)
        if self.head.exists():
            t.state["reference"], t.state["next"] = self.head.get()
        if self.tracks.exists():
            for row in self.tracks.get():
                track = dict(zip([c.split()[0] for c in TRACK.split(", ")], row, strict=True))
                pose = track["pose"]
                track |= {"position": [track.pop(c) for c in "slh"], "seen": list(track["seen"]),
                    "pose": None if pose is None else [list(pose[k : k + 4]) for k in (0, 4, 8, 12)]}
                t.state["tracks"].append(track)
        out = tracked(t, key[0], pdf)
        self.head.update((t.state["reference"], t.state["next"]))
        if t.state["tracks"]:
            self.tracks.put([(x["track_id"], x["corridor_key"], *map(float, x["position"]), None if x["pose"] is None else [float(v) for r in x["pose"] for v in r],
                [bool(v) for v in x["seen"]], x["missed"], float(x["stamp"]), x["candidate_id"], x["status"]) for x in t.state["tracks"]])
        else:
            self.tracks.clear()
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.containsKey((at,)):
            for frame in self.due.getValue((at,))[0]:
                self.seen.removeKey((int(frame),))
            self.due.removeKey((at,))
        return iter(())

    def close(self) -> None:
        pass


def track_stream(candidates: DataFrame, late: str = "10 seconds", **settings) -> DataFrame:
    """``replay.track_frames`` as a stateful stream. Start it inside of ``rocksdb``.

    ``candidates`` may have a column ``ts``, the frames' event time; else it is made from ``stamp_s``, a second on, as a stream
    takes the epoch itself for late. Rows later than ``late`` are dropped.
    """
    timed = candidates if "ts" in candidates.columns else candidates.withColumn("ts", F.timestamp_seconds(F.col("stamp_s") + 1))
    return posed(timed, "ts").withWatermark("ts", late).groupBy("session_key").transformWithStateInPandas(Tracks(**settings), TRACK_ROWS, "append", "eventTime")


class Histories(StatefulProcessor):
    """``PairHistories`` with one entry of a map for each history of the session.

    An entry holds what its medians look at. Only the widths of an outlier run that agrees with itself grow, until a width is
    admitted again or the run breaks.
    """

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.histories = handle.getMapState("histories", "pair_id int", HISTORY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("frame")
        h = PairHistories()
        columns = [c.split()[0] for c in HISTORY.split(", ")]
        if self.histories.exists():
            for (pair_id,), value in sorted(self.histories.iterator()):
                own = dict(zip(columns, value, strict=True))
                parts = [own.pop(f"pending_{c}") for c in ("distance", "left", "right")]
                own |= {c: list(own[c]) for c in ("widths", "slopes", "places")}
                h.histories.append(own | {"pair_id": pair_id, "pending": [{"distance": d, "left": a, "right": b} for d, a, b in zip(*parts, strict=True)]})
        some = lambda x: None if x is None or x != x else x
        out = []
        for r in pdf.itertuples():
            pairs = [{k: some(p[k]) for k in ("left", "right", "distance", "slope", "place")} for p in (r.pairs if r.pairs is not None else ())]
            lines = [float(x) for x in (r.lines if r.lines is not None else ())]
            out += [tuple({"session_key": key[0], **x}.get(n) for n in self.names) for x in h.step(int(r.frame), pairs, lines, bool(r.ground_found))]
        for x in h.histories:
            pending = [[float(p[c]) for p in x["pending"]] for c in ("distance", "left", "right")]
            value = {"pending_distance": pending[0], "pending_left": pending[1], "pending_right": pending[2]} | {c: [float(v) for v in x[c]] for c in ("widths", "slopes", "places")}
            value = {**{c: x.get(c) for c in columns}, **value}
            self.histories.updateValue((x["pair_id"],), tuple(value[c] for c in columns))
        yield _frame(out, HISTORY_ROWS, ("pair_id", "width_age", "place_age"))

    def close(self) -> None:
        pass


def history_stream(frames: DataFrame) -> DataFrame:
    """``replay.pair_histories`` as a stateful stream. Start it inside of ``rocksdb``."""
    names = [c.split()[0] for c in HISTORY_ROWS.split(", ")]
    kept = frames.select("session_key", "frame", "ground_found", "pairs", "lines")
    return kept.groupBy("session_key").transformWithStateInPandas(Histories(names), HISTORY_ROWS, "append", "none")
