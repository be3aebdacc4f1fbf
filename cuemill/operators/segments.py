"""Segments of a media timeline: offsets, skipping, boundaries, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import sums_before


def latest(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row per key: of rows delivered again the latest. Aggregated map-side, so a key with very many rows is no hot group."""
    rest = [c for c in df.columns if c not in (key, order)]
    packed = df.groupBy(key).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_row"))
    return packed.select(key, *[F.col(f"_row.{c}").alias(c) for c in (order, *rest)]).select(*df.columns)


def offsets(segments: DataFrame) -> DataFrame:
    """Adds ``offset_ms``: the sum of the durations of the medium's segments before this one. A medium of very many segments is
    no hot window: sums go over blocks of segments first."""
    return sums_before(segments, "media_id", "seg_idx", {"offset_ms": "duration_ms"})


def chunks_to_skip(start_offset_min: Column | float, max_seconds: Column | int) -> Column:
    """Whole nominal segments before the start offset; truncated, whatever the actual durations are."""
    a = start_offset_min if isinstance(start_offset_min, Column) else F.lit(start_offset_min)
    b = max_seconds if isinstance(max_seconds, Column) else F.lit(max_seconds)
    return F.floor(a * 60 / b).cast("int")


def skip_start(segments: DataFrame, start_offset_min: float, max_seconds: int = 300) -> DataFrame:
    """Without the segments before the start offset; offsets still count them if added first."""
    return segments.where(F.col("seg_idx") >= chunks_to_skip(start_offset_min, max_seconds))


def boundary_flags(segments: DataFrame) -> DataFrame:
    """Adds ``is_first, is_last`` within each medium, from the least and greatest index: an aggregate, not a window."""
    ends = segments.groupBy("media_id").agg(F.min("seg_idx").alias("_lo"), F.max("seg_idx").alias("_hi"))
    return segments.join(ends, "media_id").withColumns({"is_first": F.col("seg_idx") == F.col("_lo"), "is_last": F.col("seg_idx") == F.col("_hi")}).drop("_lo", "_hi")


def media_totals(segments: DataFrame, tolerance_ms: int) -> DataFrame:
    """Per medium: segments, total duration, and the largest deviation at which a stored split would still be reused."""
    return segments.groupBy("media_id").agg(F.count("*").alias("n_segments"), F.sum("duration_ms").alias("total_ms"), (F.count("*") * tolerance_ms).alias("reuse_within_ms"))
