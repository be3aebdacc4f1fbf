"""Queries on the cues of a media timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backend import ReplayBackend
from ..functions import timecode as tc
from ..functions.text import merge_bilingual, newlines, normalise_text
from ..functions.timecode import timecode_ms
from ..operators import gaps, segments, validate
from ..operators.intervals import merge_intervals, periods_and_gaps
from ..operators.prompt import segment_prompts, verification_prompt
from ..operators.stitch import PLACEHOLDER, headed, stitch
from ..session import fresh_dir, materialise, table
from ..sources import srt, state
from ..streaming.cues import deliver_once


def segment_spans(segment: DataFrame) -> DataFrame:
    """``entity, duration_ms``, one row per segment; of rows delivered again the latest counts."""
    return segment.where("segment_name is not null").groupBy(F.col("segment_name").alias("entity")).agg(F.max_by("duration_ms", F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("duration_ms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = table(spark, sf_dir, "cue").select("segment_name", "attempt", "cue_id", timecode_ms(F.col("start_tc")).alias("start_ms"), timecode_ms(F.col("end_tc")).alias("end_ms"))
    islands = merge_intervals(cue, "segment_name", "attempt", "start_ms", "end_ms", "cue_id")
    found = periods_and_gaps(islands, segment_spans(table(spark, sf_dir, "segment")), min_gap_ms=2000, min_records=2)
    return found.withColumnRenamed("entity", "segment_name")


#: A cue's time-code in DuckDB, for the strings that the cleaner knows and the lenient ``m:s`` form.
_MS = """CASE WHEN regexp_extract(translate({c},'０１２３４５６７８９','0123456789'), '(\\d{{1,2}}:\\d{{2}}(?:[:.]\\d{{1,3}})?)', 1) <> '' THEN
 (SELECT TRY_CAST(p[1] AS BIGINT)*60000 + TRY_CAST(p[2] AS BIGINT)*1000 + TRY_CAST(rpad(coalesce(p[3],''),3,'0') AS BIGINT)
  FROM (SELECT regexp_split_to_array(regexp_extract(translate({c},'０１２３４５６７８９','0123456789'), '(\\d{{1,2}}:\\d{{2}}(?:[:.]\\d{{1,3}})?)', 1), '[:.]') AS p))
 WHEN regexp_matches({c}, '^\\d+:\\d+$') THEN TRY_CAST(split_part({c},':',1) AS BIGINT)*60000 + TRY_CAST(split_part({c},':',2) AS BIGINT)*1000 END"""


def ms_sql(c: str) -> str:
    return _MS.format(c=c)


P2_SQL = f"""
WITH c AS (SELECT DISTINCT segment_name, attempt, cue_id, start_tc, end_tc FROM cue WHERE segment_name IS NOT NULL AND attempt IS NOT NULL),
top AS (SELECT segment_name, max(attempt) AS attempt FROM c GROUP BY segment_name),
t AS (SELECT segment_name, cue_id, {ms_sql("start_tc")} AS s, {ms_sql("end_tc")} AS e FROM c JOIN top USING (segment_name, attempt)),
u AS (SELECT *, max(e) OVER (PARTITION BY segment_name ORDER BY s, e, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM t WHERE s < e),
v AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY segment_name ORDER BY s, e, cue_id ROWS UNBOUNDED PRECEDING) AS g FROM u),
i AS (SELECT segment_name, g, min(s) AS f, max(e) AS t, count(*) AS n FROM v GROUP BY segment_name, g),
j AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY segment_name ORDER BY g), 0) AS p FROM i),
d AS (SELECT segment_name, max_by(duration_ms, loaded_at) AS duration_ms FROM segment GROUP BY segment_name),
l AS (SELECT d.segment_name, duration_ms, max(t) AS t FROM d LEFT JOIN i USING (segment_name) GROUP BY ALL)
SELECT 'period' AS kind, segment_name, f AS from_ms, t AS to_ms FROM i WHERE n >= 2
UNION ALL SELECT 'gap', segment_name, p, f FROM j WHERE f - p >= 2000
UNION ALL SELECT 'gap', segment_name, coalesce(t, 0), duration_ms FROM l WHERE (t IS NULL AND duration_ms > 0) OR duration_ms - t >= 2000
"""


# ---- cues: reading, repairing, checking -----------------------------------------------------------------------------
def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cue once, with its times."""
    c = table(spark, sf_dir, "cue").select("cue_id", "segment_name", "seg_idx", "attempt", "pos", "start_tc", "end_tc", "original", "english").distinct()
    return validate.with_times(c)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.latest(table(spark, sf_dir, "segment"), "segment_name").select("segment_name", "media_id", "seg_idx", "duration_ms")


def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("cue_id", "start_ms", "end_ms")


def timecode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cue").select("cue_id", tc.clean_timecode(F.col("start_tc")).alias("start_tc"), tc.clean_timecode(F.col("end_tc")).alias("end_tc")).distinct()


def timecode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted, soiled, cleaned and parsed again: as it was."""
    e = table(spark, sf_dir, "events").select("event_id", F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) / 1000, F.lit(6_000_000)).cast("bigint").alias("ms"))
    noisy = F.concat(F.element_at(F.array(F.lit("start: "), F.lit("["), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")), tc.format_timecode(F.col("ms")), F.element_at(F.array(F.lit(",end:"), F.lit(" -->")), (F.col("event_id") % 2 + 1).cast("int")))
    return e.select("event_id", "ms", tc.format_timecode(F.col("ms")).alias("text"), timecode_ms(noisy).alias("back_ms"))


def srt_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).where("start_ms is not null and end_ms is not null").select("cue_id", tc.format_srt(F.col("start_ms")).alias("start_srt"), tc.format_srt(F.col("end_ms")).alias("end_srt"))


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("cue_id", normalise_text(F.col("original")).alias("original_key"), normalise_text(F.col("english")).alias("english_key"))


def bilingual_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("cue_id", merge_bilingual(F.col("original"), F.col("english")).alias("text"))


def newline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scene").select("scene_id", newlines(F.col("reference_lyrics_og")).alias("og"), newlines(F.col("reference_lyrics_en")).alias("en")).distinct()


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).join(_segments(spark, sf_dir).select("segment_name", "duration_ms"), "segment_name", "left")


def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response with its first bad cue, if any: null reasons are valid, the others go to quarantine."""
    return validate.response_verdicts(_checked(spark, sf_dir), ["segment_name", "attempt"])


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_responses(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_responses"), F.sum("n_cues").alias("n_cues"))


def validate_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = table(spark, sf_dir, "scene").select("scene_id", "segment_name", "pos", "start_tc", "end_tc").distinct()
    checked = validate.with_times(scene).join(_segments(spark, sf_dir), "segment_name", "left")
    return validate.response_verdicts(checked, ["segment_name"]).withColumnRenamed("n_cues", "n_scenes")


def _once(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Cues with their times, each once, written: the table is read, cleared of repetitions and its time-codes are parsed once, and
    what follows works on the result. Repetitions go first, so that parsing is spread over all cores, however the
    table's files are cut."""
    c = table(spark, sf_dir, "cue").select("cue_id", "segment_name", "attempt", "pos", "start_tc", "end_tc", *more).distinct()
    return materialise(validate.with_times(c).drop("start_tc", "end_tc"), "cues")


def _active(spark: SparkSession, sf_dir: str, once: DataFrame) -> DataFrame:
    """``segment_name, attempt, n``: the active response of each segment where it is valid as a whole, and its number of cues: one
    aggregate by response and one by segment, so one row a segment."""
    c = once.join(_segments(spark, sf_dir).select("segment_name", "duration_ms"), "segment_name")
    per = c.groupBy("segment_name", "attempt").agg(F.count("*").alias("n"), F.max(validate.cue_reason().isNotNull()).alias("bad"), F.max(F.col("duration_ms").isNull()).alias("unknown"))
    top = per.groupBy("segment_name").agg(F.max(F.struct("attempt", "n", "bad", "unknown")).alias("x"))
    return top.where("not x.bad and not x.unknown").select("segment_name", "x.attempt", "x.n")


def _valid_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of the active response of each segment, where it is valid as a whole."""
    once = _once(spark, sf_dir)
    return once.join(_active(spark, sf_dir, once).select("segment_name", "attempt"), ["segment_name", "attempt"])


_C = f"""c AS (SELECT DISTINCT cue_id, segment_name, attempt, pos, start_tc, end_tc, original, english, {ms_sql("start_tc")} AS start_ms, {ms_sql("end_tc")} AS end_ms FROM cue),
d AS (SELECT segment_name, media_id, seg_idx, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY segment_name ORDER BY loaded_at DESC) AS rn FROM segment) WHERE rn = 1),
w AS (SELECT c.*, d.duration_ms, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'unreadable' WHEN start_ms >= end_ms THEN 'order' WHEN end_ms > duration_ms + 2000 THEN 'beyond' END AS why FROM c LEFT JOIN d USING (segment_name)),
r AS (SELECT segment_name, attempt, count(*) AS n_cues, min(CASE WHEN why IS NOT NULL THEN pos END) AS first_bad_pos, arg_min(why, pos) FILTER (WHERE why IS NOT NULL) AS reason FROM w GROUP BY segment_name, attempt)"""
_A = f"""{_C},
top AS (SELECT segment_name, max(attempt) AS attempt FROM c GROUP BY segment_name),
g AS (SELECT w.* FROM w JOIN top USING (segment_name, attempt) JOIN r USING (segment_name, attempt) WHERE r.reason IS NULL AND w.duration_ms IS NOT NULL)"""
_STRIP = "regexp_replace(regexp_replace({c}, '^[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ''), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '')"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_sql(c: str) -> str:
    return _STRIP.format(c=c)


def key_sql(c: str) -> str:
    return f"translate(replace(lower({strip_sql(c)}), 'ß', 'ss'), '{_PUNCT}', '')"


_MERGE = f"CASE WHEN {key_sql('original')} = {key_sql('english')} THEN {strip_sql('original')} ELSE {strip_sql('original')} || chr(10) || {strip_sql('english')} END"


def _srt_sql(c: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} % 3600000 // 60000, {c} % 60000 // 1000, {c} % 1000)"


def _clean_sql(c: str) -> str:
    t = f"translate({c},'０１２３４５６７８９','0123456789')"
    x = f"regexp_extract({t}, '(\\d{{1,2}}:\\d{{2}}(?:[:.]\\d{{1,3}})?)', 1)"
    return f"CASE WHEN {x} = '' THEN {t} ELSE {x} END"


def _lines_sql(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '\\r', chr(13)), '\\n', chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


# ---- gaps, segments, stitching --------------------------------------------------------------------------------------
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gaps.largest_gaps(_valid_cues(spark, sf_dir), _segments(spark, sf_dir).select("segment_name", "duration_ms"))
    return g.withColumn("large", gaps.has_large_gap(60_000))


def _loadable(spark: SparkSession, sf_dir: str, once: DataFrame) -> DataFrame:
    return validate.load_verdicts(once.join(_segments(spark, sf_dir).select("segment_name", "duration_ms"), "segment_name", "left"))


def load_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each segment's stored responses would be taken up again: time-codes of all of them, duration of the last."""
    return _loadable(spark, sf_dir, _cues(spark, sf_dir))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nothing more is to be asked for a segment: a segment that has been verified once, and the first and last of a medium,
    are complete as they are; others if they have no large gap; those without a loadable response never."""
    once, s = _once(spark, sf_dir), _segments(spark, sf_dir)
    flags = segments.boundary_flags(s).select("segment_name", "is_first", "is_last")
    cues = once.join(_active(spark, sf_dir, once).select("segment_name", "attempt"), ["segment_name", "attempt"])
    g = gaps.largest_gaps(cues, s.select("segment_name", "duration_ms")).select("segment_name", gaps.has_large_gap(60_000).alias("large"))
    j = flags.join(_loadable(spark, sf_dir, once), "segment_name", "left").join(g, "segment_name", "left")
    n, loaded = F.coalesce("n_responses", F.lit(0)), F.col("n_responses").isNotNull() & F.col("reason").isNull()
    done = gaps.complete(n, loaded, F.coalesce("large", F.lit(True)), F.col("is_first"), F.col("is_last"))
    return j.select("segment_name", n.alias("n_responses"), "is_first", "is_last", done.alias("complete"))


def gap_detection_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large gaps over nested lists, as a fold: a list is one segment's cues, so short by nature."""
    cues = _valid_cues(spark, sf_dir).select("segment_name", F.struct("pos", "cue_id", "start_ms", "end_ms").alias("c")).groupBy("segment_name").agg(F.array_sort(F.collect_list("c")).alias("cues"))
    j = _segments(spark, sf_dir).select("segment_name", "duration_ms").join(cues, "segment_name", "left")
    empty = F.array().cast("array<struct<pos:int,cue_id:bigint,start_ms:bigint,end_ms:bigint>>")
    return j.select("segment_name", F.coalesce(gaps.has_large_gap_nested(F.coalesce("cues", empty), F.col("duration_ms"), 60_000), F.lit(False)).alias("large"))


def empty_segment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each event type from its first to its last: an hour without events is one large gap."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("hour"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("at"))
    ends = e.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spans = ends.select("event_type", F.explode(F.sequence("a", "b")).alias("hour")).select("event_type", "hour", F.concat_ws("/", "event_type", F.col("hour").cast("string")).alias("k"), F.lit(3_600_000).cast("bigint").alias("duration_ms"))
    rel = F.col("at") - F.col("hour") * 3_600_000
    cues = e.select(F.concat_ws("/", "event_type", F.col("hour").cast("string")).alias("k"), rel.alias("pos"), rel.alias("start_ms"), rel.alias("end_ms"))
    g = gaps.largest_gaps(cues, spans.select("k", "duration_ms"), "k").withColumn("large", gaps.has_large_gap(900_000))
    return spans.join(g.select("k", "large"), "k").select("event_type", "hour", "large")


def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.offsets(_segments(spark, sf_dir)).select("media_id", "seg_idx", "offset_ms")


def start_offset_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.skip_start(segments.offsets(_segments(spark, sf_dir)), 7.0, 300).select("media_id", "seg_idx", "offset_ms", "duration_ms")


def boundary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.boundary_flags(_segments(spark, sf_dir)).select("media_id", "seg_idx", "is_first", "is_last")


def segment_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.media_totals(_segments(spark, sf_dir), 100)


def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events cut into segments of six hours: index and time within the segment."""
    rel = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) - 1704067200000
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("media_id"), rel.cast("bigint").alias("rel_ms"))
    return e.select("event_id", "media_id", F.floor(F.col("rel_ms") / 21_600_000).cast("bigint").alias("seg_idx"), F.pmod("rel_ms", F.lit(21_600_000)).alias("start_ms"))


def _stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _once(spark, sf_dir, "original", "english")
    cues = once.select("segment_name", "attempt", "pos", "start_ms", "end_ms", merge_bilingual(F.col("original"), F.col("english")).alias("text"))
    return stitch(_segments(spark, sf_dir), cues, _active(spark, sf_dir, once))


def stitch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stitched(spark, sf_dir).select("media_id", "cue_no", "seg_idx", "pos", "start_ms", "end_ms", "text")


def stitch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stitched(spark, sf_dir)
    return s.groupBy("media_id").agg(F.count("*").alias("n_cues"), F.count(F.when(F.col("pos") < 0, 1)).alias("n_missing"), F.max("end_ms").alias("end_ms"))


#: Stands for the JSON of a run's settings in ``srt_render``.
HEADER = '{"complete": true}'


def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each medium's subtitle file, the header cue (number 0) first."""
    s = headed(_stitched(spark, sf_dir), F.lit(HEADER))
    return s.select("media_id", "cue_no", srt.block(F.col("cue_no"), F.col("start_ms"), F.col("end_ms"), F.coalesce("text", F.lit(""))).alias("block"))


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitched cues written as subtitle files and read back."""
    path = fresh_dir(spark, "srt")
    srt.write_srt(_stitched(spark, sf_dir).where("media_id is not null").withColumn("text", F.coalesce("text", F.lit(""))), path)
    back = srt.read_srt(spark, f"{path}/*")
    return back.select(F.url_decode(F.regexp_extract("path", "media_id=([^/]+)/", 1)).alias("media_id"), F.col("cue_no").cast("bigint").alias("cue_no"), "start_ms", "end_ms", "text")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each segment that has cues, as it is stored: all responses in order. A list is one segment's, so short."""
    c = _cues(spark, sf_dir).where("segment_name is not null and attempt is not null")
    cue = F.struct("pos", "cue_id", F.struct(F.col("start_tc").alias("start"), F.col("end_tc").alias("end"), "original", "english").alias("c"))
    lists = c.groupBy("segment_name", "attempt").agg(F.array_sort(F.collect_list(cue)).alias("l"))
    answer = F.struct("attempt", F.struct(F.transform("l", lambda x: x["c"]).alias("subtitles"), F.lit(None).cast("string").alias("thoughts")).alias("r"))
    per = lists.groupBy("segment_name").agg(F.transform(F.array_sort(F.collect_list(answer)), lambda x: x["r"]).alias("responses"))
    j = per.join(_segments(spark, sf_dir), "segment_name")
    return j.select(F.col("segment_name").alias("name"), F.size("responses").alias("total_attempts"), F.col("duration_ms").cast("int").alias("video_duration_ms"), (F.col("seg_idx") % 3).alias("subtitles_prompt_version"), "responses")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_dir(spark, "states")
    state.write_state(_states(spark, sf_dir), path)
    return path


def yaml_state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written, one file a segment, and read back: the cues of the active response."""
    s = state.read_state(spark, _stored(spark, sf_dir))
    last = state.active_response(F.col("responses"))
    cues = s.select("name", "total_attempts", "video_duration_ms", F.posexplode(last["subtitles"]).alias("no", "c"))
    return cues.select("name", "total_attempts", "video_duration_ms", "no", F.col("c.start").alias("start_tc"), F.col("c.end").alias("end_tc"), F.col("c.original").alias("original"), F.col("c.english").alias("english"))


def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of another prompt version than the wanted count as absent."""
    s = state.read_state(spark, _stored(spark, sf_dir), version=("subtitles_prompt_version", 1))
    return s.select("name", F.size("responses").alias("n_responses"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of each segment as JSON in a prompt; the spacing of JSON is the JVM's, so there is no SQL twin."""
    s = table(spark, sf_dir, "scene").drop("loaded_at").distinct().withColumnsRenamed({"start_tc": "start", "end_tc": "end"})
    return segment_prompts(_segments(spark, sf_dir), s)


def cue_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers in either spelling of the keys, every third one broken, read into cues: a list is one segment's, so short."""
    c = _cues(spark, sf_dir).where("segment_name is not null and attempt is not null")
    short = F.struct(F.col("c.start_tc").alias("s"), F.col("c.end_tc").alias("e"), F.col("c.original").alias("og"), F.col("c.english").alias("en"))
    long = F.struct(F.col("c.start_tc").alias("start"), F.col("c.end_tc").alias("end"), F.col("c.original").alias("original"), F.col("c.english").alias("english"))
    lists = c.select("segment_name", "attempt", "seg_idx", "pos", "cue_id", F.struct("start_tc", "end_tc", "original", "english").alias("c")).select("segment_name", "attempt", "seg_idx", F.struct("pos", "cue_id", short.alias("a"), long.alias("b")).alias("x"))
    g = lists.groupBy("segment_name", "attempt").agg(F.array_sort(F.collect_list("x")).alias("l"), F.min("seg_idx").alias("i"))
    raw = F.when(F.col("i") % 3 == 0, F.to_json(F.struct(F.transform("l", lambda x: x["a"]).alias("subs")))).when(F.col("i") % 3 == 1, F.to_json(F.struct(F.transform("l", lambda x: x["b"]).alias("subtitles")))).otherwise(F.lit("{broken"))
    read = g.select("segment_name", "attempt", state.parse_cue_list(raw).alias("cues")).select("segment_name", "attempt", F.posexplode("cues").alias("no", "c"))
    return read.select("segment_name", "attempt", "no", F.col("c.start").alias("start_tc"), F.col("c.end").alias("end_tc"), F.col("c.original").alias("original"), F.col("c.english").alias("english"))


def verification_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of a second pass over each segment with large gaps."""
    g = gap_detection(spark, sf_dir).where("large")
    return g.select("segment_name", verification_prompt(F.lit("Subtitle the segment."), F.col("duration_ms")).alias("prompt"))


def replay_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment asked again, answered from the recorded responses: the cues of the active one, a line each."""
    line = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("start_tc", "end_tc", "original", "english")])
    cues = validate.active(_cues(spark, sf_dir)).groupBy(F.col("segment_name").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "cue_id", line.alias("x")))).alias("l"))
    recorded = cues.select("request_id", F.array_join(F.transform("l", lambda c: c["x"]), "\n").alias("response"))
    asked = _segments(spark, sf_dir).select(F.col("segment_name").alias("request_id"), F.lit("").alias("prompt"))
    return ReplayBackend(recorded).run(asked).select("request_id", "response")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue files as a stream, each record once. A stream reads folders or patterns: here one that fits a single name."""
    return deliver_once(spark, f"{sf_dir}/cue.parque[t]", fresh_dir(spark, "cues")).select("cue_id", "segment_name", "attempt", "pos", "original")


QUERIES = {
    "p2_found": p2_found,
    "timecode_parse": timecode_parse,
    "timecode_clean": timecode_clean,
    "timecode_roundtrip": timecode_roundtrip,
    "srt_timestamps": srt_timestamps,
    "text_normalise": text_normalise,
    "bilingual_merge": bilingual_merge,
    "newline_normalise": newline_normalise,
    "validate_responses": validate_responses,
    "quarantine_reasons": quarantine_reasons,
    "validate_scenes": validate_scenes,
    "gap_detection": gap_detection,
    "gap_detection_hof": gap_detection_hof,
    "empty_segment_gap": empty_segment_gap,
    "load_check": load_check,
    "completeness": completeness,
    "segment_offsets": segment_offsets,
    "start_offset_skip": start_offset_skip,
    "boundary_flags": boundary_flags,
    "segment_durations": segment_durations,
    "segment_assign": segment_assign,
    "stitch": stitch_query,
    "stitch_summary": stitch_summary,
    "srt_render": srt_render,
    "srt_roundtrip": srt_roundtrip,
    "yaml_state_roundtrip": yaml_state_roundtrip,
    "version_filter": version_filter,
    "prompt_render": prompt_render,
    "cue_lists": cue_lists,
    "verification_prompts": verification_prompts,
    "replay_inference": replay_inference,
    "stream_once": stream_once,
}

_GAPS = f"""{_A},
x AS (SELECT segment_name, pos, start_ms, end_ms, max(end_ms) OVER (PARTITION BY segment_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
p AS (SELECT segment_name, arg_min(start_ms, pos) AS h, max(start_ms - pe) AS i, max(end_ms) AS e FROM x GROUP BY segment_name),
q AS (SELECT d.segment_name, d.media_id, d.seg_idx, duration_ms, coalesce(h, duration_ms) AS head_ms, i AS inner_ms, duration_ms - coalesce(e, 0) AS tail_ms FROM d LEFT JOIN p USING (segment_name))"""
_LOAD = """a AS (SELECT segment_name, attempt, arg_min(why, pos) FILTER (WHERE why <> 'beyond') AS form, bool_or(coalesce(why, '') = 'beyond') AS late FROM w GROUP BY segment_name, attempt),
v AS (SELECT segment_name, max(attempt) + 1 AS n_responses, coalesce(arg_min(form, attempt) FILTER (WHERE form IS NOT NULL), CASE WHEN arg_max(late, attempt) THEN 'beyond' END) AS why FROM a GROUP BY segment_name)"""
_OFF = "o AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM d)"
_FLAG = "f AS (SELECT segment_name, media_id, seg_idx, seg_idx = min(seg_idx) OVER (PARTITION BY media_id) AS is_first, seg_idx = max(seg_idx) OVER (PARTITION BY media_id) AS is_last FROM d)"
_STITCH = f"""{_A}, {_OFF},
u AS (SELECT media_id, seg_idx, pos, start_ms + offset_ms AS start_ms, end_ms + offset_ms AS end_ms, {_MERGE} AS text FROM g JOIN o USING (segment_name)
  UNION ALL SELECT media_id, seg_idx, -1, offset_ms, offset_ms + duration_ms, '{PLACEHOLDER}' FROM o WHERE segment_name NOT IN (SELECT segment_name FROM g)),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, pos) AS cue_no FROM u),
s AS (SELECT media_id, seg_idx, pos, cue_no, CASE WHEN cue_no = 1 THEN greatest(start_ms, 1) ELSE start_ms END AS start_ms, end_ms, text FROM n)"""

SQL = {
    "p2_found": P2_SQL,
    "timecode_parse": f"WITH {_C} SELECT cue_id, start_ms, end_ms FROM c",
    "timecode_clean": f"SELECT DISTINCT cue_id, {_clean_sql('start_tc')} AS start_tc, {_clean_sql('end_tc')} AS end_tc FROM cue",
    "timecode_roundtrip": "SELECT event_id, ms, printf('%02d:%02d.%03d', ms // 60000, ms % 60000 // 1000, ms % 1000) AS text, ms AS back_ms FROM (SELECT event_id, (epoch_us(ts) // 1000) % 6000000 AS ms FROM events)",
    "srt_timestamps": f"WITH {_C} SELECT cue_id, {_srt_sql('start_ms')} AS start_srt, {_srt_sql('end_ms')} AS end_srt FROM c WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL",
    "text_normalise": f"WITH {_C} SELECT cue_id, {key_sql('original')} AS original_key, {key_sql('english')} AS english_key FROM c",
    "bilingual_merge": f"WITH {_C} SELECT cue_id, {_MERGE} AS text FROM c",
    "newline_normalise": f"SELECT DISTINCT scene_id, {_lines_sql('reference_lyrics_og')} AS og, {_lines_sql('reference_lyrics_en')} AS en FROM scene",
    "validate_responses": f"WITH {_C} SELECT segment_name, attempt, n_cues, first_bad_pos, reason FROM r",
    "quarantine_reasons": f"WITH {_C} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n_responses, sum(n_cues)::BIGINT AS n_cues FROM r GROUP BY 1",
    "validate_scenes": f"""WITH s0 AS (SELECT DISTINCT scene_id, segment_name, pos, start_tc, end_tc, {ms_sql("start_tc")} AS start_ms, {ms_sql("end_tc")} AS end_ms FROM scene),
d AS (SELECT segment_name, max_by(duration_ms, loaded_at) AS duration_ms FROM segment GROUP BY segment_name),
w AS (SELECT s0.*, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'unreadable' WHEN start_ms >= end_ms THEN 'order' WHEN end_ms > duration_ms + 2000 THEN 'beyond' END AS why FROM s0 LEFT JOIN d USING (segment_name))
SELECT segment_name, count(*) AS n_scenes, min(CASE WHEN why IS NOT NULL THEN pos END) AS first_bad_pos, arg_min(why, pos) FILTER (WHERE why IS NOT NULL) AS reason FROM w GROUP BY segment_name""",
    "gap_detection": f"WITH {_GAPS} SELECT segment_name, duration_ms, head_ms, inner_ms, tail_ms, coalesce(greatest(head_ms, inner_ms, tail_ms) >= 60000, false) AS large FROM q",
    "completeness": f"""WITH {_GAPS}, {_FLAG}, {_LOAD}
SELECT f.segment_name, coalesce(n_responses, 0) AS n_responses, is_first, is_last,
 coalesce(n_responses, 0) > 0 AND why IS NULL AND (n_responses > 1 OR is_first OR is_last OR NOT coalesce(greatest(head_ms, inner_ms, tail_ms) >= 60000, false)) AS complete
FROM f LEFT JOIN v USING (segment_name) LEFT JOIN q USING (segment_name)""",
    "cue_lists": f"""WITH {_C}, i AS (SELECT segment_name, attempt, min(seg_idx) AS i FROM cue GROUP BY segment_name, attempt)
SELECT segment_name, attempt, (row_number() OVER (PARTITION BY segment_name, attempt ORDER BY pos, cue_id) - 1)::INT AS no, start_tc, end_tc, original, english FROM c JOIN i USING (segment_name, attempt) WHERE i % 3 < 2""",
    "verification_prompts": f"""WITH {_GAPS} SELECT segment_name, 'Subtitle the segment.' || chr(10) || chr(10) || '<verification_pass>' || chr(10) || '  Regenerate all subtitles of the segment (' || printf('%.1f', duration_ms / 1000.0::DOUBLE) || ' seconds); leave nothing out.' || chr(10) || '</verification_pass>' AS prompt
FROM q WHERE coalesce(greatest(head_ms, inner_ms, tail_ms) >= 60000, false)""",
    "load_check": f"WITH {_C}, {_LOAD} SELECT segment_name, n_responses, why AS reason FROM v",
    "gap_detection_hof": f"WITH {_GAPS} SELECT segment_name, coalesce(greatest(head_ms, inner_ms, tail_ms) >= 60000, false) AS large FROM q",
    "empty_segment_gap": """WITH e AS (SELECT event_type, epoch(ts)::BIGINT // 3600 AS hour, epoch_ms(ts) AS t_ms FROM (SELECT event_type, date_trunc('milliseconds', ts) AS ts FROM events)),
h AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM e GROUP BY event_type),
g AS (SELECT event_type, hour, t_ms - coalesce(lag(t_ms) OVER (PARTITION BY event_type, hour ORDER BY t_ms), hour * 3600000) AS d, (hour + 1) * 3600000 - t_ms AS rest FROM e),
m AS (SELECT event_type, hour, greatest(max(d), min(rest)) AS most FROM g GROUP BY event_type, hour)
SELECT h.event_type, h.hour, coalesce(most, 3600000) >= 900000 AS large FROM h LEFT JOIN m USING (event_type, hour)""",
    "srt_roundtrip": f"WITH {_STITCH} SELECT media_id, cue_no, start_ms, end_ms, rtrim(coalesce(text, ''), chr(10)) AS text FROM s",
    "yaml_state_roundtrip": f"""WITH {_C}, n AS (SELECT segment_name, count(DISTINCT attempt) AS n, max(attempt) AS attempt FROM c GROUP BY segment_name)
SELECT segment_name AS name, n::INT AS total_attempts, duration_ms::INT AS video_duration_ms, (row_number() OVER (PARTITION BY segment_name ORDER BY pos, cue_id) - 1)::INT AS no, start_tc, end_tc, original, english FROM c JOIN n USING (segment_name, attempt) JOIN d USING (segment_name)""",
    "version_filter": f"WITH {_C} SELECT segment_name AS name, count(DISTINCT attempt)::INT AS n_responses FROM c JOIN d USING (segment_name) WHERE seg_idx % 3 = 1 GROUP BY segment_name",
    "segment_offsets": f"WITH {_C}, {_OFF} SELECT media_id, seg_idx, offset_ms FROM o",
    "start_offset_skip": f"WITH {_C}, {_OFF} SELECT media_id, seg_idx, offset_ms, duration_ms FROM o WHERE seg_idx >= 1",
    "boundary_flags": f"WITH {_C}, {_FLAG} SELECT media_id, seg_idx, is_first, is_last FROM f",
    "segment_durations": f"WITH {_C} SELECT media_id, count(*) AS n_segments, sum(duration_ms)::BIGINT AS total_ms, count(*) * 100 AS reuse_within_ms FROM d GROUP BY media_id",
    "segment_assign": "SELECT event_id, event_type AS media_id, rel // 21600000 AS seg_idx, rel % 21600000 AS start_ms FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 - 1704067200000 AS rel FROM events)",
    "stitch": f"WITH {_STITCH} SELECT media_id, cue_no, seg_idx, pos, start_ms, end_ms, text FROM s",
    "stitch_summary": f"WITH {_STITCH} SELECT media_id, count(*) AS n_cues, count(*) FILTER (WHERE pos < 0) AS n_missing, max(end_ms) AS end_ms FROM s GROUP BY media_id",
    "srt_render": f"""WITH {_STITCH} SELECT media_id, cue_no, cue_no || chr(10) || {_srt_sql('start_ms')} || ' --> ' || {_srt_sql('end_ms')} || chr(10) || coalesce(text, '') AS block FROM s
UNION ALL SELECT DISTINCT media_id, 0, '0' || chr(10) || '00:00:00,000 --> 00:00:00,001' || chr(10) || '("complete": true)' FROM s""",
    "replay_inference": f"""WITH {_C}, top AS (SELECT segment_name, max(attempt) AS attempt FROM c GROUP BY segment_name),
k AS (SELECT segment_name, string_agg(concat_ws('|', coalesce(start_tc, ''), coalesce(end_tc, ''), coalesce(original, ''), coalesce(english, '')), chr(10) ORDER BY pos, cue_id) AS response FROM c JOIN top USING (segment_name, attempt) GROUP BY segment_name)
SELECT d.segment_name AS request_id, response FROM d LEFT JOIN k USING (segment_name)""",
    "stream_once": "SELECT DISTINCT cue_id, segment_name, attempt, pos, original FROM cue",
}
