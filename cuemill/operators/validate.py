"""Whole-response validation: one bad cue makes the whole response invalid; invalid ones go to quarantine with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import timecode_ms


def with_times(df: DataFrame, start: str = "start_tc", end: str = "end_tc") -> DataFrame:
    return df.withColumns({"start_ms": timecode_ms(F.col(start)), "end_ms": timecode_ms(F.col(end))})


def cue_reason(duration_col: str = "duration_ms", buffer_ms: int = 2000):
    """Why a cue is bad: 'unreadable', 'order' (start not before end) or 'beyond' (ends after duration and buffer)."""
    return (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "unreadable")
        .when(F.col("start_ms") >= F.col("end_ms"), "order")
        .when(F.col("end_ms") > F.col(duration_col) + buffer_ms, "beyond")
    )


def response_verdicts(cues: DataFrame, keys: list[str], buffer_ms: int = 2000) -> DataFrame:
    """Per response (``keys``): ``n_cues``, ``first_bad_pos`` and its ``reason``, both null for a valid response.

    ``cues`` holds start_ms, end_ms, pos and duration_ms (null: not checked). An aggregate with map-side combination.
    """
    bad = cues.withColumn("_why", cue_reason(buffer_ms=buffer_ms))
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("pos", "_why")))
    return bad.groupBy(*keys).agg(F.count("*").alias("n_cues"), first.alias("_bad")).select(*keys, "n_cues", F.col("_bad.pos").alias("first_bad_pos"), F.col("_bad._why").alias("reason"))


def load_verdicts(cues: DataFrame, key: str = "segment_name", version: str = "attempt", buffer_ms: int = 2000) -> DataFrame:
    """``key, n_responses, reason``: whether a stored list of responses would be taken up again. Time-codes and their order are checked
    in every response, the duration only against the last one; ``reason`` is null for a list that is loaded. Versions
    count from 0. Aggregates with map-side combination."""
    bad = cues.withColumn("_why", cue_reason(buffer_ms=buffer_ms))
    each = bad.groupBy(key, version).agg(F.min(F.when(F.col("_why") != "beyond", F.struct("pos", "_why"))).alias("_form"), F.max(F.when(F.col("_why") == "beyond", True)).alias("_beyond"))
    first = F.min(F.when(F.col("_form").isNotNull(), F.struct(F.col(version).alias("v"), F.col("_form._why").alias("why"))))
    per = each.groupBy(key).agg(first.alias("_f"), F.max_by("_beyond", version).alias("_last"), (F.max(version) + 1).alias("n_responses"))
    return per.select(key, "n_responses", F.coalesce(F.col("_f.why"), F.when(F.col("_last"), "beyond")).alias("reason"))


def active(cues: DataFrame, key: str = "segment_name", version: str = "attempt") -> DataFrame:
    """The rows of each key's highest version: an aggregate joined back, so that no key is collected in one task."""
    top = cues.groupBy(key).agg(F.max(version).alias(version))
    return cues.join(top, [key, version], "left_semi")
