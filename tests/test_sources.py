import json

import pytest

from cuemill.settings import Settings, load, masked_json
from cuemill.sources import srt, state
from cuemill.streaming.cues import deliver_once
from pyspark.sql import functions as F


def test_srt_round_trip(spark, tmp_path):
    rows = [("m", 1, 0, 1, "(x)"), ("m", 2, 3_723_004, 3_724_000, "two\nlines"), ("n", 1, 5, 6, "日本語")]
    df = spark.createDataFrame(rows, "media_id string, cue_no int, start_ms bigint, end_ms bigint, text string")
    srt.write_srt(df, str(tmp_path / "out"))
    back = srt.read_srt(spark, str(tmp_path / "out" / "*"))
    got = sorted((r.path.split("media_id=")[1].split("/")[0], r.cue_no, r.start_ms, r.end_ms, r.text) for r in back.collect())
    assert got == sorted(rows)


def test_srt_reads_odd_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\r\n00:00:01,5 --> 00:00:02,000\r\nfirst\r\n\r\nstill first\r\n\r\n2\r\n00:00:03.000 --> 00:00:04.000\r\n\r\njunk\r\n", encoding="utf-8")
    (tmp_path / "b.srt").write_text("nothing here")
    got = sorted((r.cue_no, r.start_ms, r.end_ms, r.text) for r in srt.read_srt(spark, str(tmp_path)).collect())
    assert got == [(1, 1500, 2000, "first\n\nstill first"), (2, 3000, 4000, "\njunk")]


def test_state_files(spark, tmp_path):
    good = {"name": "part_001", "total_attempts": 2, "video_duration_ms": 5, "subtitles_prompt_version": 18, "responses": [{"subtitles": [{"start": "00:01", "end": "00:02", "original": "a", "english": "b"}], "thoughts": None}]}
    (tmp_path / "a.yaml").write_text(json.dumps(good))
    (tmp_path / "b.yaml").write_text("[1, 2]")
    (tmp_path / "c.yaml").write_text("{broken")
    (tmp_path / "d.yaml").write_text(json.dumps(good | {"subtitles_prompt_version": 17, "responses": []}))
    every = state.read_state(spark, str(tmp_path))
    assert every.count() == 2
    now = state.read_state(spark, str(tmp_path), version=("subtitles_prompt_version", 18))
    assert [r[0].subtitles[0].english for r in now.select(state.active_response(F.col("responses"))).collect()] == ["b"]
    assert [r[0] for r in every.where("subtitles_prompt_version = 17").select(state.active_response(F.col("responses"))).collect()] == [None]
    state.write_state(now.drop("path"), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("name=part_001/*.txt"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == good
    assert state.read_state(spark, str(tmp_path / "out")).drop("path").collect() == now.drop("path").collect()


def test_yaml_states(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: part_001\ntotal_attempts: 1\nvideo_duration_ms: 5\nlyrics_prompt_version: 9\nresponse:\n  scenes:\n  - start: '00:01'\n    end: '00:02'\n    reference_lyrics_og: |-\n      eins\n      zwei\n", encoding="utf-8")
    got = state.read_state(spark, str(tmp_path), state.LYRICS_STATE, ("lyrics_prompt_version", 9)).collect()
    assert [(r.name, r.response.scenes[0].reference_lyrics_og, r.response.global_summary) for r in got] == [("part_001", "eins\nzwei", None)]


def test_cue_lists_in_either_spelling(spark):
    raw = ['{"subs":[{"s":"1","e":"2","og":"x","en":"y"}]}', '{"subtitles":[{"start":"1","end":"2","original":"x","english":"y"}],"thoughts":"t"}', "junk", "{}", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(state.parse_cue_list(F.col("x"))).collect()]
    assert got == [[("1", "2", "x", "y")]] * 2 + [None] * 3


def _cue_rows(spark, rows):
    df = spark.createDataFrame(rows, "cue_id bigint, original string, day int")
    return df.selectExpr("cue_id", "'m' media_id", "0 seg_idx", "'s' segment_name", "0 attempt", "0 pos", "'' start_tc", "'' end_tc", "original", "'' english", "timestamp_ntz'2025-01-01 00:00:00' made_at", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, day) loaded_at")


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A second run over more files delivers only the new rows; keys are known from the first."""
    source, place = str(tmp_path / "in"), str(tmp_path / "place")
    _cue_rows(spark, [(1, "a", 0), (1, "a", 3), (2, None, 1), (None, "x", 1), (9, "undated", None)]).coalesce(1).write.parquet(source)
    assert sorted((r.cue_id, r.original) for r in deliver_once(spark, source, place).collect()) == [(1, "a"), (2, None)]
    _cue_rows(spark, [(1, "a", 30), (3, "c", 4), (2, None, 9)]).coalesce(1).write.mode("append").parquet(source)
    files = set((tmp_path / "place" / "table").glob("*.parquet"))
    assert sorted((r.cue_id, r.original) for r in deliver_once(spark, source, place).collect()) == [(1, "a"), (2, None), (3, "c")]
    new = [str(f) for f in (tmp_path / "place" / "table").glob("*.parquet") if f not in files]
    assert [r.cue_id for r in spark.read.parquet(*new).collect()] == [3]
    assert deliver_once(spark, source, place).count() == 3


def test_settings_precedence_and_mask(tmp_path):
    s = load({"split": {"max_seconds": 200}, "unknown": 1}, {"CUEMILL_SPLIT__MAX_SECONDS": "100", "CUEMILL_LIMITS__KEY": ' "secret" ', "CUEMILL_CHECKS__IGNORE_START": "no"})
    assert (s.split.max_seconds, s.limits.key, s.checks.ignore_start) == (200, "secret", False)
    env = tmp_path / ".env"
    env.write_text('# not this\nCUEMILL_RETRY__PER_RUN=7\nexport CUEMILL_SPLIT__RE_ENCODE__FPS="0.5"\nCUEMILL_FOLDERS__OUT=/somewhere\nother=1\n')
    t = load({}, {"CUEMILL_RETRY__PER_RUN": "2"}, env_file=env)
    assert (t.retry.per_run, t.split.re_encode.fps, t.folders.out) == (2, 0.5, "/somewhere") and "somewhere" not in masked_json(t)
    with pytest.raises(ValueError):
        load({"checks": {"gap_seconds": 0}}, {})
    assert "secret" not in masked_json(s) and "key" not in json.loads(masked_json(Settings()))["limits"]
