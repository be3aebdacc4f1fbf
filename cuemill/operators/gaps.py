"""Large gaps in list order: before the first cue, between cues (against the latest end so far) and after the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_gaps(cues: DataFrame, spans: DataFrame, key: str = "segment_name") -> DataFrame:
    """Per row of ``spans`` (``key, duration_ms``): ``head_ms, inner_ms, tail_ms``. Cues are taken in order of ``pos``, not of
    time. Without cues the whole duration is the head gap. ``inner_ms`` is null with fewer than two cues."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    g = cues.select(key, "pos", "start_ms", "end_ms", F.max("end_ms").over(before).alias("_max"))
    per = g.groupBy(key).agg(F.min_by("start_ms", "pos").alias("head_ms"), F.max(F.col("start_ms") - F.col("_max")).alias("inner_ms"), F.max("end_ms").alias("_end"))
    out = spans.join(per, key, "left")
    return out.select(key, "duration_ms", F.coalesce("head_ms", "duration_ms").alias("head_ms"), "inner_ms", (F.col("duration_ms") - F.coalesce("_end", F.lit(0))).alias("tail_ms"))


def has_large_gap(threshold_ms: int) -> Column:
    """Over the result of ``largest_gaps``; a gap as long as the threshold is large."""
    return F.coalesce(F.greatest("head_ms", "inner_ms", "tail_ms") >= threshold_ms, F.lit(False))


def complete(n_responses: Column, loaded: Column, large_gap: Column, is_first: Column, is_last: Column, retries: int = 1, ignore_start: bool = True, ignore_end: bool = True) -> Column:
    """Whether nothing more is to be asked for a segment: it has a response, and either verification is off, or was tried more
    often than ``retries``, or the segment is a first or last one that is let pass, or there is no large gap."""
    passed = (is_first & ignore_start) | (is_last & ignore_end)
    return F.coalesce((n_responses > 0) & loaded, F.lit(False)) & (F.lit(retries <= 0) | (n_responses > retries) | passed | ~large_gap)


def has_large_gap_nested(cues: Column, duration_ms: Column, threshold_ms: int) -> Column:
    """The same for a nested list of ``struct<start_ms, end_ms>``, row-locally: a fold over the array."""
    zero = F.struct(F.lit(None).cast("bigint").alias("end"), F.lit(False).alias("gap"))
    fold = F.aggregate(
        cues,
        zero,
        lambda s, c: F.struct(
            F.greatest(s["end"], c["end_ms"].cast("bigint")).alias("end"),
            (s["gap"] | (c["start_ms"] - F.coalesce(s["end"], F.lit(0)) >= threshold_ms)).alias("gap"),
        ),
        lambda s: s["gap"] | (duration_ms - s["end"] >= threshold_ms),
    )
    return F.when(F.size(cues) == 0, duration_ms >= threshold_ms).otherwise(fold)
