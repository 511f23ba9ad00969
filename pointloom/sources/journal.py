"""Journals: JSON lines with one record for each frame, torn tails, resumption, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SPLITS = ("locked_test", "validation", "development")


def write(frames: DataFrame, path: str, mode: str = "append") -> None:
    frames.write.mode(mode).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files (file, block, n, value) and, on a file's last line, whether it was ended.

    Spark's reader splits files by bytes and finds the line ends. A file whose lines with their ends are one byte
    longer than itself lacks its last end; no file is opened outside of the readers. Files must not be compressed. ``block`` and ``n`` order the lines of a file.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    ends = read.groupBy("file").agg((F.sum(F.octet_length("value") + 1) > F.first("size")).alias("torn"), F.max(F.struct("block", "n")).alias("last"))
    torn = ends.where("torn").select("file", F.col("last.block").alias("block"), F.col("last.n").alias("n"), F.lit(False).alias("ended"))
    return read.join(torn, ["file", "block", "n"], "left").select("file", "block", "n", F.coalesce("ended", F.lit(True)).alias("ended"), "value")


def read_completed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete record of each frame: a last line that was not ended is dropped.

    Of several records of a frame the last of its file counts, of several files the one with the greatest name.
    """
    good = lines(spark, path).where("ended and trim(value) <> ''")
    rows = good.select(F.struct("file", "block", "n").alias("at"), F.from_json("value", schema).alias("r")).where("r.frame_index is not null")
    return rows.groupBy(F.col("r.frame_index").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def first_and_duplicates(rows: DataFrame, order: str) -> DataFrame:
    """The first record of each frame and how often the frame came."""
    w = Window.partitionBy("frame_index")
    return rows.withColumns({"times": F.count("*").over(w), "__n": F.row_number().over(w.orderBy(order))}).where("__n = 1").drop("__n")


def remaining(frames: DataFrame, completed: DataFrame) -> DataFrame:
    """Frames that a resumed run still has to do."""
    return frames.join(completed.select("frame_index"), "frame_index", "left_anti")


def same_identity(completed: DataFrame, identity: str) -> None:
    """A journal of another configuration is not resumed."""
    other = completed.where(~F.col("identity").eqNullSafe(F.lit(identity))).limit(1).count()
    if other:
        raise ValueError("the journal was written with another configuration")


def with_roles(runs: DataFrame, roles: DataFrame) -> DataFrame:
    """Recordings with their split; those without one are unassigned."""
    return runs.join(roles, "run", "left").withColumn("role", F.coalesce("role", F.lit("unassigned")))


def development_only(runs: DataFrame) -> DataFrame:
    return runs.where("role = 'development'")


def require_development(runs: DataFrame) -> None:
    """An error if a run is not of the development split."""
    other = runs.where("role <> 'development'").select("run").first()
    if other is not None:
        raise ValueError(f"run {other.run} is not for development")


def view(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames (run, message_index) that were chosen to be looked at."""
    return frames.join(F.broadcast(chosen.distinct()), ["run", "message_index"], "left_semi")  # written by hand


def select_frames(frames: DataFrame, first: int | None = None, last: int | None = None, chosen: list[int] | None = None,
    most: int | None = None) -> DataFrame:
    """Frames of a window, a list, and at most so many from the start."""
    out = frames
    if first is not None:
        out = out.where(F.col("frame_index") >= first)
    if last is not None:
        out = out.where(F.col("frame_index") <= last)
    if chosen is not None:
        out = out.where(F.col("frame_index").isin(*chosen))
    return out.orderBy("frame_index").limit(most) if most is not None else out


def card(decisions: DataFrame, intrusions: DataFrame) -> DataFrame:
    """A short record for each frame: the decision, its first intrusion, the range of all."""
    c = intrusions.groupBy("frame_index").agg(F.min_by(F.struct("candidate_id", "evidence", "range_from_sensor_m"),
            F.struct("range_from_sensor_m", "candidate_id")).alias("first"), F.round(F.min("range_from_sensor_m"), 4).alias("nearest_m"),
        F.round(F.max("range_from_sensor_m"), 4).alias("farthest_m"))
    return decisions.join(c, "frame_index", "left")


def _once(spark: SparkSession, path: str, text: str) -> None:
    """A new file in any store; an error where it exists."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def manifest(spark: SparkSession, folder: str, **given) -> None:
    """The description of a run, written once."""
    _once(spark, f"{folder}/manifest.json", json.dumps(given, sort_keys=True, indent=1))


def machine(spark: SparkSession, folder: str) -> None:
    """What the run ran on: versions, parallelism, memory of executors."""
    import platform

    sc = spark.sparkContext
    about = {"spark": spark.version, "python": platform.python_version(), "system": platform.platform(),
        "parallelism": sc.defaultParallelism, "executor_memory": sc._conf.get("spark.executor.memory", "1g"), "master": sc.master}
    _once(spark, f"{folder}/machine.json", json.dumps(about, sort_keys=True, indent=1))


def summary(frames: DataFrame, folder: str) -> None:
    """The summary of a finished run: a row for each run, written once."""
    from ..operators.evaluate import run_summary

    rows = [r.asDict() for r in run_summary(frames).collect()]  # one row for each run
    _once(frames.sparkSession, f"{folder}/summary.json", json.dumps(rows, sort_keys=True, indent=1))


def own(spark: SparkSession, folder: str, run_id: str) -> None:
    """Claim a folder for one writer: the lock file can be made once only."""
    _once(spark, f"{folder}/run.lock", run_id)


def run_id(name: str, when_ns: int) -> str:
    return f"{name}-{when_ns}"


def expected(messages: DataFrame) -> DataFrame:
    """How many messages each run and topic has (run, topic), to compare with what was processed."""
    return messages.groupBy("run", "topic").agg(F.count("*").alias("expected"))


def inventory(spark: SparkSession, root: str, roles: DataFrame) -> DataFrame:
    """Recordings under a folder, by their descriptions, with their split."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "metadata.yaml").option("recursiveFileLookup", "true").load(root)
    return with_roles(found.select(F.element_at(F.split("path", "/"), -2).alias("run"),
            F.regexp_replace("path", "/metadata.yaml$", "").alias("folder")).distinct(), roles)


def search_gate(frames: DataFrame, gate: str) -> DataFrame:
    """Frames that a search looks at: all, those with a decision that isn't a failure, or those with candidates."""
    rules = {"none": "true", "decided": "decision not in ('processing_timeout', 'processing_error', 'insufficient_geometry')",
        "candidates": "candidates > 0"}
    return frames.where(rules[gate])


#: Boxes (s, l, h; borders excluded) that a study of one recording looks in; fixed values.
STUDY_GATES = {
    "e01": "s > 0.4 and s < 40 and abs(l) < 1.7 and h > -1.7 and h < 1.4",
    "e03": "s > 1 and s < 30 and l > -3 and l < -0.4 and h > -1.7 and h < 2.2",
    "none": "false",
}


def compact(candidates: DataFrame) -> DataFrame:
    """What a result says of its candidates: names, extents and ranges, without their members."""
    given = [c for c in ("hypothesis", "evidence", "reason", "corridor_segment", "model_id") if c in candidates.columns]
    extent = F.struct(*[F.col(f"extent_{a}_m").alias(f"{a}_m") for a in "slh"]).alias("observed_extent_m")
    return candidates.select("frame_index", "candidate_id", *given, "kind", "branch", "unique_xyz", extent, "s_min_m", "h_min_m", "range_from_sensor_m",
        F.lit(True).alias("conditional"))


def cards(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One record for a frame: its decision with its compact candidates as an array, in the order of their names."""
    each = compact(candidates)
    packed = each.groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct(*[c for c in each.columns if c != "frame_index"]))).alias("listed"))
    return decisions.join(packed, "frame_index", "left")
