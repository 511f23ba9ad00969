"""Live operators on Structured Streaming: load shedding, journal, sessions, tracks, joins, rates."""

from __future__ import annotations

import threading
import uuid
from collections import Counter

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.marks import newest_picture
from .stateful import history_stream, track_stream  # noqa: F401  live operators, too


def frames_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New files of a folder as a stream; one file in a micro-batch gives the sequential mode, which never drops."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def shed_load(batch: DataFrame, order: str = "reception") -> DataFrame:
    """The latest frame of a micro-batch, with the number of those dropped for it."""
    return batch.agg(F.max_by(F.struct(*batch.columns), order).alias("f"),
        (F.count("*") - 1).alias("dropped")).where("f is not null").select("f.*", "dropped")


def write_journal(stream: DataFrame, path: str, checkpoint: str, keep_latest: bool = False, transform=None, event_time: str | None = None,
    late: str = "1 hour"):
    """Exactly one JSON line for each (session_id, sequence).

    Each micro-batch goes to a folder of its own number, overwritten when it is repeated after a
    failure. Keys that were seen are state of the stream; with ``event_time`` only those within the
    watermark are, so the state stays bounded.
    """
    key = ["session_id", "sequence"]
    once = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key) if event_time else stream.dropDuplicates(key)

    def put(batch: DataFrame, n: int) -> None:
        rows = shed_load(batch) if keep_latest else batch
        (transform(rows) if transform else rows).write.mode("overwrite").json(f"{path}/batch={n}")

    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def delivered_once(messages: DataFrame, key: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key of a stream once, with what ``Balance`` adds up: received before, written after.

    The keys that were seen are the stream's state; with ``event_time`` only those within the watermark.
    """
    came = messages.observe("received", F.count(F.lit(1)).alias("received"))
    once = came.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key) if event_time else came.dropDuplicates(key)
    return once.observe("written", F.count(F.lit(1)).alias("written"))


class Balance(StreamingQueryListener):
    """Adds up what running queries observe, batch by batch, so that received = written + dropped can be told at any time.

    Register it before a query starts. ``failed`` counts queries that ended with an error; their last batch will be repeated.
    """

    def __init__(self):
        self._counts: dict[str, Counter] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _of(self, query_id) -> tuple[Counter, threading.Event]:
        with self._lock:
            return self._counts.setdefault(str(query_id), Counter()), self._ended.setdefault(str(query_id), threading.Event())

    def onQueryStarted(self, event):
        self._of(event.id)

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics
        if seen:
            counts, _ = self._of(event.progress.id)
            counts["batches"] += 1
            for row in seen.values():
                counts.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        counts, ended = self._of(event.id)
        counts["failed"] += event.exception is not None
        ended.set()

    def of(self, query, wait_s: float = 60.0) -> dict:
        """Counts of a query that has ended; its last events are waited for."""
        counts, ended = self._of(query.id)
        ended.wait(wait_s)
        out = {k: counts.get(k, 0) for k in ("batches", "received", "written", "failed")}
        return out | {"dropped": out["received"] - out["written"]}


def within_budget(spark: SparkSession, action, seconds: float) -> dict:
    """Run an action (a function that starts Spark jobs) with a deadline: its jobs are cancelled when it is over.

    Returns the status, the action's result (None where it has none) and the error. A late result is not waited for.
    """
    group = f"budget-{uuid.uuid4().hex}"
    found: dict = {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "a frame's budget", interruptOnCancel=True)
        try:
            found["result"] = action()
        except Exception as e:  # the status tells of it, whatever it is
            found["error"] = f"{type(e).__name__}: {e}"[:500]

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        return {"status": "processing_timeout", "result": None, "error": None}
    return {"status": "processing_error" if "error" in found else "ok", "result": found.get("result"), "error": found.get("error")}


def pictures(stream: DataFrame, put, checkpoint: str, hertz: float = 2.0):
    """At most so many pictures a second: of each batch the newest for each slot, never one older than what the slot has shown."""
    shown: dict = {}

    def show(batch: DataFrame, _: int) -> None:
        newest = newest_picture(batch)
        for p in newest.collect():  # one row for each slot
            key = (p.session_id, p.reception)
            if key > shown.get(p.slot, (-1, -1)):
                shown[p.slot] = key
                put(p)

    return stream.writeStream.foreachBatch(show).trigger(processingTime=f"{round(1000 / hertz)} milliseconds").option("checkpointLocation",
        checkpoint)


def join_cards(cards: DataFrame, clouds: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Result cards with their clouds by sequence; both sides forget what is later than the watermark."""
    c = cards.withWatermark("ts", late)
    d = clouds.select(F.col("sequence").alias("cloud_sequence"), F.col("ts").alias("cloud_ts"),
        F.col("points").alias("cloud_points")).withWatermark("cloud_ts", late)
    return c.join(d, F.expr(f"sequence = cloud_sequence and cloud_ts between ts - interval {late} and ts + interval {late}"))


def live_view(cards: DataFrame, clouds: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Every result card once, with its cloud where one comes; a card whose cloud stays away is given out when the watermark has passed it.

    ``cards``: ts, sequence, ...; ``clouds``: ts, sequence, points. The state holds what the watermark hasn't passed, on either side.
    """
    c = cards.withWatermark("ts", late)
    d = clouds.select(F.col("sequence").alias("cloud_sequence"), F.col("ts").alias("cloud_ts"), F.col("points").alias("cloud_points")).withWatermark("cloud_ts", late)
    met = c.join(d, F.expr(f"sequence = cloud_sequence and cloud_ts between ts - interval {late} and ts + interval {late}"), "leftOuter")
    return met.withColumn("has_cloud", F.col("cloud_sequence").isNotNull())


def view_rates(view: DataFrame, seconds: int = 5) -> DataFrame:
    """The live view by tumbling windows, in the same query: its rate, how many cards had a cloud, the statuses that were seen."""
    w = view.groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
    return w.agg((F.count(F.lit(1)) / seconds).alias("rate_hz"), F.count_if("has_cloud").alias("with_cloud"), F.array_sort(F.collect_set("status")).alias("statuses")).select(
        F.col("w.start").alias("start"), "rate_hz", "with_cloud", "statuses")


def windowed_rates(frames: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """Frames a second in tumbling windows."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg((F.count("*") / seconds).alias("rate_hz"))


def counters(frames: DataFrame) -> DataFrame:
    """Received, written, timed out and failed frames, whose sum must balance."""
    return frames.agg(F.count("*").alias("received"), F.count_if(F.col("status") == "ok").alias("written"),
        F.count_if(F.col("status") == "processing_timeout").alias("timeout"),
        F.count_if(F.col("status") == "processing_error").alias("failed"), F.lit(0).alias("dropped"))
