"""Timing features over cues ``(doc_id, pos, start_ms, end_ms)``; blank cues count for the duration only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.operators.ordering import position_chunk, with_position, with_previous

SCENE_GAP_SECONDS = 20


def duration_seconds(cues: DataFrame) -> DataFrame:
    """End of the last cue in file order, which need not be the latest end."""
    return cues.groupBy("doc_id").agg((F.max_by("end_ms", "pos") / 1000.0).alias("duration_seconds"))


def _per_minute(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / (seconds / 60.0)).otherwise(F.lit(0.0))


def line_gaps(line_table: DataFrame) -> DataFrame:
    """Seconds from the start of the previous line of the document, null in the first line.

    Cut into chunks of positions, so a document of any length is spread over tasks.
    """
    before = with_previous(line_table, ["doc_id"], ["pos"], "start_ms", "_before", chunk=position_chunk("pos"))
    return before.withColumn("gap_seconds", (F.col("start_ms") - F.col("_before")) / 1000.0).drop("_before")


def timing_profile(cues: DataFrame, line_table: DataFrame, threshold_seconds: float = SCENE_GAP_SECONDS) -> DataFrame:
    """``duration_seconds``, ``dialogue_density`` and ``scene_change_density`` for every document with cues."""
    counted = line_gaps(line_table.select("doc_id", "pos", "start_ms")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum((F.col("gap_seconds") >= threshold_seconds).cast("bigint")).alias("_scenes"))
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    return duration_seconds(cues).join(counted, "doc_id", "left").select(
        "doc_id",
        seconds.alias("duration_seconds"),
        _per_minute(F.coalesce("_lines", F.lit(0)), seconds).alias("dialogue_density"),
        _per_minute(F.coalesce("_scenes", F.lit(0)), seconds).alias("scene_change_density"),
    )


def dialogue_density(cues: DataFrame, line_table: DataFrame) -> DataFrame:
    """Lines per minute, 0 where the duration is not positive."""
    counted = line_table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_lines"))
    return duration_seconds(cues).join(counted, "doc_id", "left").select(
        "doc_id", _per_minute(F.coalesce("_lines", F.lit(0)), F.col("duration_seconds")).alias("dialogue_density"))


def scene_change_density(cues: DataFrame, line_table: DataFrame,
                         threshold_seconds: float = SCENE_GAP_SECONDS) -> DataFrame:
    """Start-to-start gaps of at least the threshold, per minute."""
    return timing_profile(cues, line_table, threshold_seconds).select("doc_id", "scene_change_density")


def event_cues(events: DataFrame, key: str, at_ms: Column, tie: str) -> DataFrame:
    """Cues from an event log: each key is a document, its events are numbered along time, and time starts at its
    first event. The numbering is spread over tasks, so no key is sorted in one of them."""
    flat = events.select(F.col(key).alias("doc_id"), F.col(tie), at_ms.alias("_at"))
    numbered = with_position(flat, ["doc_id"], [F.col("_at"), F.col(tie)])
    origin = flat.groupBy("doc_id").agg(F.min("_at").alias("_zero"))
    placed = skew.lookup(numbered, origin, ["doc_id"], [tie])
    return placed.select("doc_id", "pos", tie, (F.col("_at") - F.col("_zero")).alias("start_ms"),
                         (F.col("_at") - F.col("_zero")).alias("end_ms"))
