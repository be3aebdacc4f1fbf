"""Rendering nested rows into JSON and text templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the fields of a scene, in the order of the output.
SCENE_FIELDS = ("start", "end", "description", "contains_vocal_music", "song_title", "original_artist", "performer_in_video", "original_language", "reference_lyrics_og", "reference_lyrics_en")
TEMPLATE = "<task>\n  Subtitle the segment.\n</task>\n<scenes>\n  %s\n</scenes>"


def scenes_json(scenes: Column) -> Column:
    """A list of scenes as JSON with nulls kept; the text ``null`` where there is no list."""
    return F.coalesce(F.to_json(scenes, {"ignoreNullFields": "false"}), F.lit("null"))


def segment_prompts(segments: DataFrame, scenes: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``segment_name, n_scenes, prompt``: each segment with its scenes in order. ``scenes``: segment_name, pos and the fields of a
    scene. The scenes of a five-minute segment are a handful by nature."""
    packed = scenes.groupBy("segment_name").agg(F.array_sort(F.collect_list(F.struct("pos", *SCENE_FIELDS))).alias("_s"))
    bare = F.transform("_s", lambda x: F.struct(*[x[f].alias(f) for f in SCENE_FIELDS]))
    j = segments.select("segment_name").distinct().join(packed, "segment_name", "left")
    return j.select("segment_name", F.coalesce(F.size("_s"), F.lit(0)).alias("n_scenes"), F.format_string(template, scenes_json(F.when(F.col("_s").isNotNull(), bare))).alias("prompt"))


def seconds(ms: Column) -> Column:
    """Seconds with one decimal, rounded as the binary number is that stands for them: where a half is just below its decimal, down.
    (The JVM's formatting rounds the decimal.)"""
    d, t = ms / 1000.0, F.pmod(ms, F.lit(1000)) / 1000.0
    below = d - F.floor(d)  # exact
    half = F.when(below < t, 0).when(below > t, 1).when(F.pmod(ms, F.lit(1000)).isin(50, 450, 550, 650, 750), 1).otherwise(0)
    tenths = F.floor(ms / 100) + F.when(F.pmod(ms, F.lit(100)) > 50, 1).when(F.pmod(ms, F.lit(100)) == 50, half).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def verification_prompt(prompt: Column, duration_ms: Column) -> Column:
    """The prompt of a second pass over a segment in which large gaps were found."""
    # the tag is a fixed value
    note = F.format_string("<verification_pass>\n  Regenerate all subtitles of the segment (%s seconds); leave nothing out.\n</verification_pass>", seconds(duration_ms))
    return F.concat(prompt, F.lit("\n\n"), note)
