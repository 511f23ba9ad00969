"""Job 1: decide the frames of recordings that have no decision yet.

    python -m jobs.decide_frames LINEITEM SUPPLIER NATION OUT [--config FILE]

A recording is a nation, a frame a supplier of it, its points the supplier's lines, as in the rest of the engine.
Frames go the whole way from points to one decision by the straight profile.

Output, Parquet under OUT:

* ``journal/recording=.../``: one card for each frame, with the identity of the configuration;
* ``summary/recording=.../``: frames and decisions of each recording.

The journal is its own high-water mark: a run takes the frames that no card names. So a run that was killed while
it wrote, or between journal and summary, is made up for by the next one, and a run without new frames writes nothing. The
summary is derived: recordings whose numbers differ from the journal's are counted again and replaced by dynamic
partition overwrite. A journal of another configuration is refused. A frame is complete when it is recorded; points that come later don't
reopen it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.config import DETECTOR, SPARSE
from pointloom.plans import fixtures, registry
from pointloom.session import materialise
from pointloom.sources import journal

from .common import command_line, existing, log, read_config, settings

DEFAULTS = {"role_of_recording": {}, "default_role": "development", "roles": ["development", "validation"], "files_per_recording": 1}
CARD = "frame_index long, status string, candidates long, intrusions long, nearest_intrusion_m double, decision string, reason string, role string, identity string"
SUMMARY = "frames long, intruded long, undecided long, nearest_m double"


def identity(config: dict) -> str:
    """Of all that decisions depend on; where cards are written doesn't matter."""
    told = [{k: v for k, v in config.items() if k != "files_per_recording"}, repr(SPARSE), repr(DETECTOR)]
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]


def recorded_frames(supplier: DataFrame, nation: DataFrame, config: dict) -> DataFrame:
    """Frames with their recording and its role, of the roles that are asked for."""
    runs = nation.select(F.col("n_nationkey").alias("run_key"), F.col("n_name").alias("run"))
    listed = list(config["role_of_recording"].items())
    roles = nation.sparkSession.createDataFrame(listed, "run string, role string")
    named = journal.with_roles(runs, roles).withColumn("role", F.when(F.col("role") == "unassigned", config["default_role"]).otherwise(F.col("role")))
    named = F.broadcast(named.where(F.col("role").isin(*config["roles"])))  # one row for each recording
    return supplier.join(named, F.col("s_nationkey") == F.col("run_key")).select(F.col("s_suppkey").alias("frame_index"), F.col("run").alias("recording"), "role")


def run(spark: SparkSession, lineitem: str, supplier: str, nation: str, out: str, config: dict | None = None) -> dict:
    """Decide what is new, bring the summary up to date; returns what was read and written."""
    config = DEFAULTS | (config or {})
    mine = identity(config)
    with settings(spark, **{"spark__sql__sources__partitionOverwriteMode": "dynamic", "spark__sql__requireAllClusterKeysForCoPartition": None}):
        done = existing(spark, f"{out}/journal", CARD + ", recording string")
        journal.same_identity(done, mine)
        frames = recorded_frames(spark.read.parquet(supplier), spark.read.parquet(nation), config)
        records = spark.read.parquet(lineitem)
        seen = records.select(F.col("l_suppkey").alias("frame_index")).distinct()
        fresh = materialise(journal.remaining(frames.join(seen, "frame_index", "left_semi"), done), "fresh-frames")
        new = fresh.count()
        log.info("%s: %d frames without a decision", lineitem, new)
        if new:
            of_frames = records.join(fresh.select(F.col("frame_index").alias("l_suppkey")), "l_suppkey", "left_semi")
            cards = registry.straight_cards(spark, fixtures.grouped(fixtures.cloud_of(of_frames), dealt=True))
            named = cards.join(fresh, "frame_index").withColumn("identity", F.lit(mine))
            dealt = named.repartition("recording", F.pmod(F.xxhash64("frame_index"), F.lit(config["files_per_recording"])))
            dealt.write.mode("append").partitionBy("recording").parquet(f"{out}/journal")
        written = summarise(spark, out)
    log.info("%s: %d cards and the summaries of %d recordings written", out, new, written)
    return {"frames": new, "recordings": written}


def summarise(spark: SparkSession, out: str) -> int:
    """Count recordings again whose summary differs from the journal; returns how many."""
    cards = existing(spark, f"{out}/journal", CARD + ", recording string")
    now = cards.groupBy("recording").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("decision") == "conditional_intrusion").alias("intruded"),
        F.count_if(F.col("decision") == "insufficient_evidence").alias("undecided"), F.min("nearest_intrusion_m").alias("nearest_m"))
    told = existing(spark, f"{out}/summary", SUMMARY + ", recording string").select("recording", F.struct("frames", "intruded", "undecided", "nearest_m").alias("told"))
    stale = now.join(told, "recording", "left").where(~F.col("told").eqNullSafe(F.struct("frames", "intruded", "undecided", "nearest_m"))).drop("told")
    stale = materialise(stale, "summaries")  # read to the end before its partitions are replaced
    n = stale.count()
    if n:
        stale.repartition("recording").write.mode("overwrite").partitionBy("recording").parquet(f"{out}/summary")
    return n


def output(spark: SparkSession, out: str) -> DataFrame:
    """Every card with the numbers of its recording."""
    cards = existing(spark, f"{out}/journal", CARD + ", recording string")
    return cards.join(existing(spark, f"{out}/summary", SUMMARY + ", recording string"), "recording")


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], [("lineitem", "points"), ("supplier", "frames"), ("nation", "recordings"), ("out", "output folder")],
        lambda spark, a: run(spark, a.lineitem, a.supplier, a.nation, a.out, read_config(spark, a.config, DEFAULTS)))
