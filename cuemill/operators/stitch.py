"""Stitching: the cues of all segments of a medium on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parentheses
from ..session import materialise
from .prefix import sums_before

#: Fixed value: the text that stands in for a segment without a usable response.
PLACEHOLDER = "Error processing subtitles for this segment."


def stitch(segments: DataFrame, cues: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``media_id, seg_idx, pos, cue_no, start_ms, end_ms, text``.

    ``segments``: media_id, seg_idx, segment_name, duration_ms. ``cues``: segment_name, pos, start_ms, end_ms, text of valid
    responses, one row a cue, times within the segment. ``sizes``: ``segment_name, n`` of the segments that have cues, counted from ``cues`` if not given; with a column ``attempt``, in
    ``cues`` too, it says which of a segment's cues count. A segment without cues gives one
    placeholder over its whole duration (pos -1). The medium's first cue starts at 1 ms at the earliest, behind the header (see
    ``headed``). Numbers count from 1 in order of segment and position; they are put together from counts per
    segment, so that no task holds a whole medium's cues or segments.
    """
    counts = sizes if sizes is not None else cues.groupBy("segment_name").agg(F.count("*").alias("n"))
    on = ["segment_name", "attempt"] if "attempt" in counts.columns else ["segment_name"]
    placed = segments.select("media_id", "seg_idx", "segment_name", "duration_ms").join(counts.select(*on, F.col("n").alias("_n")), "segment_name", "left")
    placed = placed.withColumn("_size", F.coalesce("_n", F.lit(1)))
    placed = sums_before(placed, "media_id", "seg_idx", {"offset_ms": "duration_ms", "_before": "_size"})
    placed = materialise(placed, "placed")  # one row a segment, used twice below, and sent around only if it is small
    within = Window.partitionBy("segment_name").orderBy("pos")
    real = cues.join(placed.where("_n is not null").drop("_size"), on).withColumn("_no", F.row_number().over(within))
    real = real.select("media_id", "seg_idx", "pos", (F.col("_before") + F.col("_no")).alias("cue_no"), (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), "text")
    missing = placed.where("_n is null").select(
        "media_id", "seg_idx", F.lit(-1).alias("pos"), (F.col("_before") + 1).alias("cue_no"), F.col("offset_ms").alias("start_ms"), (F.col("offset_ms") + F.col("duration_ms")).alias("end_ms"), F.lit(PLACEHOLDER).alias("text")
    )
    whole = real.unionByName(missing)
    return whole.withColumn("start_ms", F.when(F.col("cue_no") == 1, F.greatest("start_ms", F.lit(1))).otherwise(F.col("start_ms")))


def headed(stitched: DataFrame, info: Column) -> DataFrame:
    """The stitched cues with each medium's header cue in front: number 0, 0 to 1 ms, the text of ``info`` (settings as JSON) with
    braces made parentheses, since players take braces for style codes."""
    first = stitched.select("media_id").distinct().select(
        "media_id", F.lit(-1).alias("seg_idx"), F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("cue_no"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(1).cast("bigint").alias("end_ms"), parentheses(info).alias("text")
    )
    return first.unionByName(stitched.select(*first.columns))
