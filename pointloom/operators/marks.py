"""Manual marks, display labels and constant records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("rail", "floor", "wall")
CONFIDENCE = ("high", "medium", "low")


def mark_problems(marks: DataFrame, rows: int, columns: int) -> DataFrame:
    """Marks (frame_index, kind, confidence, row_lo, row_hi, col_lo, col_hi) that can't be used, with the reason."""
    reason = (
        F.when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(),
            "unknown_kind").when(~F.col("confidence").isin(*CONFIDENCE) | F.col("confidence").isNull(), "unknown_confidence")
        .when((F.col("row_lo") > F.col("row_hi")) | (F.col("col_lo") > F.col("col_hi")),
            "empty_area").when((F.col("row_lo") < 0) | (F.col("row_hi") >= rows) | (F.col("col_lo") < 0) | (F.col("col_hi") >= columns),
            "outside_of_grid")
    )
    return marks.withColumn("problem", reason).where("problem is not null")


def marked_points(gridded: DataFrame, marks: DataFrame) -> DataFrame:
    """Points of an angular grid with the mark whose area holds their bin; of several the first by kind."""
    m = marks.select("frame_index", "kind", "confidence", "row_lo", "row_hi", "col_lo", "col_hi")
    hit = gridded.join(m, "frame_index").where("row between row_lo and row_hi and col between col_lo and col_hi")
    return hit.groupBy("frame_index", "source_index").agg(F.min_by(F.struct("kind", "confidence"),
            F.struct("kind", "confidence")).alias("m")).select("frame_index", "source_index", "m.*")


def display_text(decisions: DataFrame) -> DataFrame:
    """A line of text for each frame's decision; a late result is labelled as such."""
    near = F.concat(F.lit(" at "), F.format_number("nearest_intrusion_m", 1), F.lit(" m"))
    text = F.concat_ws("", F.col("decision"), F.when(F.col("nearest_intrusion_m").isNotNull(), near))
    return decisions.withColumn("text", F.when(F.coalesce(F.col("delayed"), F.lit(False)),
            F.concat(F.lit("delayed: "), text)).otherwise(text) if "delayed" in decisions.columns else text)


def newest_picture(pictures: DataFrame) -> DataFrame:
    """The picture to show in each slot: of the latest session the latest reception; late ones never replace it."""
    return pictures.groupBy("slot").agg(F.max_by(F.struct("session_id", "reception", "frame_index"),
            F.struct("session_id", "reception")).alias("p")).select("slot", "p.*")


def own_path(hypotheses: DataFrame) -> DataFrame:
    """The own track is never chosen from geometry alone."""
    return hypotheses.withColumns({"own_path_selected": F.lit(False), "own_path_reason": F.lit("not_selected_from_geometry")})


def elevated_structures(frames: DataFrame) -> DataFrame:
    """Nothing is said about structures above the profile."""
    return frames.withColumns({"elevated_evaluated": F.lit(False), "absence_is_not_clear": F.lit(True)})


def highlight(cands: DataFrame, accepted: DataFrame) -> DataFrame:
    """Distinct member rows of the accepted candidates (frame_index, candidate_id)."""
    return cands.join(accepted.select("frame_index", "candidate_id"), ["frame_index", "candidate_id"], "left_semi").select("frame_index",
        F.explode("members").alias("source_index")).distinct()


def status_of(seconds: Column, budget_s: float, error: Column) -> Column:
    """The status of a frame by its budget: late answers are timeouts, whatever they hold."""
    return F.when(seconds > budget_s, "processing_timeout").when(error.isNotNull(), "processing_error").otherwise("ok")
