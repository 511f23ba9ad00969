"""From the messages of a recording to a journal of decisions, in runs that can be resumed.

A run takes the messages that the journal has no record of, decodes them, groups exact places, decides every frame and appends one JSON line for
each. A message that can't be decoded has a record that says so and fails nobody else's; one without a valid point has no ground.
Records carry the identity of the configuration; a journal of another one is refused. Messages come from any source that gives ``pointcloud.MESSAGE``
rows: a recording (``format("bag")``), or a table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DETECTOR, PROFILE, RULE, SPARSE, Attachment
from ..operators import cloud, inferred, rule
from ..session import materialise
from ..sources import journal, pointcloud
from . import registry
from .fixtures import grouped

RECORD = "frame_index long, stamp_ns long, frame_id string, identity string, corridor_source string, status string, error string, candidates long, intrusions long, nearest_intrusion_m double, decision string, reason string"


@dataclass(frozen=True)
class Plan:
    """What a run does: along the straight profile or inferred corridors, and where a session is attached."""

    source: str = "configured_straight"
    place: Attachment | None = None

    def __post_init__(self):
        if self.source not in ("configured_straight", "inferred"):
            raise ValueError(f"unknown corridor source {self.source}")

    @property
    def identity(self) -> str:
        told = [self.source, repr(self.place), repr(SPARSE), repr(DETECTOR), repr(PROFILE), repr(RULE)]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:16]


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """The journal's records, the last of each frame; none where there is no journal yet."""
    try:
        return journal.read_completed(spark, f"{folder}/journal", RECORD)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def decide(spark: SparkSession, messages: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(cards, candidates with their evidence) of messages that can be decoded; ``candidates`` are of all hypotheses."""
    pts = grouped(cloud.valid(pointcloud.points(messages, "double")))
    every = messages.select("frame_index").distinct()
    if plan.source == "inferred":
        _, found, frames = registry.along_pairs(spark, None, plan.place, pts)
        judged = materialise(rule.with_evidence(inferred.candidates(found)), "judged")
    else:
        _, judged, frames = registry.decided(spark, None, pts)
    frames = every.join(frames, "frame_index", "left").fillna(False, ["ground_found"]).withColumn("profile_applicable", F.lit(True))
    empty = "insufficient_geometry" if plan.source == "inferred" else "ok"  # a frame without a place has no ground
    frames = frames.withColumns({"status": F.coalesce("status", F.lit(empty)), "corridor_source": F.lit(plan.source)})
    return rule.decide(frames, judged), judged


def run(spark: SparkSession, messages: DataFrame, folder: str, plan: Plan = Plan(), first: int | None = None, last: int | None = None) -> dict:
    """Append the missing records of a window of messages to the journal; returns how many there were of each kind."""
    done = completed(spark, folder)
    journal.same_identity(done, plan.identity)
    before = done.count()
    if not before:
        journal.manifest(spark, folder, identity=plan.identity, corridor_source=plan.source, attachment=repr(plan.place))
        journal.machine(spark, folder)
    asked = journal.select_frames(messages, first, last)
    left = materialise(pointcloud.with_errors(journal.remaining(asked, done)), "messages")
    if left.isEmpty():
        return {"seen": asked.count(), "completed_before": before, "processed": 0, "errors": 0, "identity": plan.identity}
    heads = left.select("frame_index", "stamp_ns", "frame_id", "error")
    cards, judged = decide(spark, left.where("error is null").drop("error"), plan)
    listed = journal.cards(cards, judged).select("frame_index", "status", "candidates", "intrusions", "nearest_intrusion_m", "decision", "reason", "listed")
    failed = F.col("error").isNotNull()
    records = heads.join(listed, "frame_index", "left").withColumns({
        "identity": F.lit(plan.identity), "corridor_source": F.lit(plan.source), "absence_is_not_clear": F.lit(True),
        "status": F.when(failed, "processing_error").otherwise(F.col("status")), "decision": F.when(failed, "processing_error").otherwise(F.col("decision")),
        "reason": F.when(failed, "frame_not_finished").otherwise(F.col("reason")),
    })
    records = materialise(records, "records")
    n = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
    journal.write(records, f"{folder}/journal")
    return {"seen": asked.count(), "completed_before": before, "processed": n.n, "errors": n.errors, "identity": plan.identity}
