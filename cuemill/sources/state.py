"""State files of segments: one mapping per file, as YAML; written as JSON, which is YAML too."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUE = "struct<start:string,end:string,original:string,english:string>"
SUBTITLE_STATE = f"name string, total_attempts int, video_duration_ms int, subtitles_prompt_version int, responses array<struct<subtitles:array<{CUE}>,thoughts:string>>"
SCENE = "struct<start:string,end:string,description:string,contains_vocal_music:boolean,song_title:string,original_artist:string,performer_in_video:string,original_language:string,reference_lyrics_og:string,reference_lyrics_en:string>"
LYRICS_STATE = f"name string, total_attempts int, video_duration_ms int, lyrics_prompt_version int, response struct<global_summary:string,scenes:array<{SCENE}>,thoughts:string>"
#: A cue list as a model answers it: long names and short ones.
CUE_LIST = "subs array<struct<s:string,e:string,og:string,en:string,start:string,end:string,original:string,english:string>>"


def parse_cue_list(raw: Column) -> Column:
    """``array<struct<start, end, original, english>>`` of a raw answer in either spelling; null if it isn't one."""
    both = F.from_json(raw, f"{CUE_LIST}, {CUE_LIST.replace('subs', 'subtitles', 1)}")
    cues = F.coalesce(both["subtitles"], both["subs"])
    return F.transform(cues, lambda c: F.struct(*[F.coalesce(c[a], c[b]).alias(a) for a, b in (("start", "s"), ("end", "e"), ("original", "og"), ("english", "en"))]))


def _load(batches):
    for b in batches:
        out = []
        for text in b.column("value").to_pylist():
            try:
                x = json.loads(text)  # JSON is YAML too
            except ValueError:
                x = _yaml(text)
            out.append(json.dumps(x, ensure_ascii=False, default=str) if isinstance(x, dict) else None)
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "json"])


def _yaml(text: str):
    """What a YAML text says, None if it can't be read. An error where the library is missing, rather than files that vanish."""
    import yaml

    try:
        return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None


def read_state(spark: SparkSession, path: str, schema: str = SUBTITLE_STATE, version: tuple[str, int] | None = None) -> DataFrame:
    """``path`` and the fields of ``schema`` for each state file; files that can't be read, aren't mappings or are of another
    version than the wanted are left out, as if absent."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    x = raw.mapInArrow(_load, "path string, json string").where("json is not null").select("path", F.from_json("json", schema).alias("x")).select("path", "x.*")
    return x.where(F.col(version[0]) == version[1]) if version else x


def write_state(df: DataFrame, path: str, key: str = "name") -> None:
    """One file per row, a JSON mapping, in the folder ``key=value`` under ``path``: ``key`` must tell rows apart. Fields in order, nulls
    kept. Rows are spread by key, and each task writes its files one after the other."""
    rows = df.select(F.col(key).alias("_name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.repartition("_name").sortWithinPartitions("_name").withColumnRenamed("_name", key).write.partitionBy(key).mode("errorifexists").text(path)


def active_response(responses: Column) -> Column:
    """The last response, null if there is none."""
    return F.try_element_at(responses, F.lit(-1))
