"""SubRip subtitle files: one file is one medium."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parentheses
from ..functions.timecode import format_srt

_TIME = r"(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})"
_BLOCK = rf"(?s)^\s*(\d+)[^\S\n]*\n[^\S\n]*{_TIME}[^\S\n]*-->[^\S\n]*{_TIME}[^\n]*(?:\n(.*))?$"


def block(cue_no: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """One cue of a subtitle file, without the blank line behind it."""
    return F.format_string("%d\n%s --> %s\n%s", cue_no, format_srt(start_ms), format_srt(end_ms), text)


def header_text(info: Column) -> Column:
    """The text of the header cue (0 to 1 ms): a JSON of the run's settings, braces made parentheses."""
    return parentheses(info)


def _ms(parts: Column, first: int) -> Column:
    h, m, s, f = (F.get(parts, F.lit(first + i)) for i in range(4))
    return h.cast("bigint") * 3600000 + m.cast("bigint") * 60000 + s.cast("bigint") * 1000 + F.rpad(f, 3, "0").cast("bigint")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """``path, cue_no, start_ms, end_ms, text`` of every cue of the files under ``path``. Blocks are told by their number and time
    lines, so blank lines inside a cue's text stay; a block that isn't one is left out; line breaks of any kind."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n|\r", "\n").alias("value"))
    cut = F.split("value", rf"\n+(?=[^\S\n]*\d+[^\S\n]*\n[^\S\n]*{_TIME}[^\S\n]*-->)")
    b = raw.select("path", F.explode(cut).alias("b"))
    parts = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.call_function("regexp_extract", F.col("b"), F.lit(_BLOCK), i))
    p = b.where(F.col("b").rlike(_BLOCK)).select("path", parts.alias("p"))
    return p.select("path", F.get("p", F.lit(0)).cast("int").alias("cue_no"), _ms(F.col("p"), 1).alias("start_ms"), _ms(F.col("p"), 5).alias("end_ms"), F.regexp_replace(F.get("p", F.lit(9)), r"\n+\z", "").alias("text"))


def write_srt(cues: DataFrame, path: str, key: str = "media_id") -> None:
    """A folder per medium under ``path`` with its cues in order. A long medium is spread over several files, ordered by name:
    rows are range-partitioned by medium and number, not gathered by medium."""
    rows = cues.select(key, "cue_no", F.concat(block(F.col("cue_no"), F.col("start_ms"), F.col("end_ms"), F.col("text")), F.lit("\n")).alias("value"))
    rows.repartitionByRange(key, "cue_no").sortWithinPartitions(key, "cue_no").drop("cue_no").write.partitionBy(key).mode("errorifexists").text(path)
