import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuemill.operators.prompt import seconds
from cuemill.functions import ident, media, text, timecode


def values(spark, rows, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(f(F.col("x"))).collect()]


TIMES = {
    "03:52.000,start:": 232000, "01:23.456": 83456, "start: 00:10": 10000, "05:07:4": 307400, "00:10.1234": 10123, "99:99.9": 6039900, "00:01:23": 1230, "00:01:23.456": 1230,
    "123:45.6": 1425600, "1:2": 62000, "０１:２３.４５６": 83456, "abc": None, "": None, "12.5": None, None: None, " 02:00.5 -->": 120500, "1:2.5": 62500, "1:x": None, "1:2:3:4": None,
}


def test_timecodes(spark):
    assert dict(zip(TIMES, values(spark, list(TIMES), timecode.timecode_ms))) == TIMES
    assert values(spark, ["03:52.000,start:", "abc", None], timecode.clean_timecode) == ["03:52.000", "abc", None]
    slow = values(spark, list(TIMES), lambda c: timecode.parse_ms(timecode.clean_timecode(c)))
    assert slow == list(TIMES.values())


def test_format_is_undone_by_parse(spark):
    ms = [0, 1, 999, 1000, 59_999, 60_000, 5_999_999, 123_456]
    df = spark.createDataFrame([(x,) for x in ms], "x bigint")
    assert [r[0] for r in df.select(timecode.timecode_ms(timecode.format_timecode(F.col("x")))).collect()] == ms
    assert [r[0] for r in df.select(timecode.format_srt(F.col("x"))).collect()][-1] == "00:02:03,456"


def test_text(spark):
    assert values(spark, ["　 Straße!\x1c ", " ", "", None, " STRASSE "], text.normalise_text) == ["strasse", "", "", None, "strasse"]
    merged = spark.createDataFrame([("Hello!", "hello"), ("Straße", "STRASSE"), ("a ", " b"), (None, "b"), ("", "")], "o string, e string").select(text.merge_bilingual(F.col("o"), F.col("e")))
    assert [r[0] for r in merged.collect()] == ["Hello!", "Straße", "a\nb", None, ""]
    assert values(spark, ["a\\r\\nb", "a\r\nb\rc", None], text.newlines) == ["a\nb", "a\nb\nc", None]
    assert values(spark, ["ΣΊΣΥΦΟΣ ﬁ", None], text.casefold) == ["σίσυφοσ fi", None]
    assert values(spark, ["Hello, world!", "hello world"], text.normalise_query) == ["hello world"] * 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_strip_is_unicode_strip(spark, xs):
    xs = [x.replace("\x00", "") for x in xs]
    keep = [x for x in xs if x.isprintable() or x.isspace()]
    assert values(spark, keep, text.strip) == [x.strip() for x in keep] if keep else True


@pytest.mark.parametrize(
    "model, code",
    [
        ("gemini-3.5-flash-lite", "g35l"), ("google-gla:gemini-3.6-flash", "g36f"), ("google-gla:gemini-3.1-pro", "g31p"), ("gemini-2.5-flash-preview", "g25fp"), ("gemini-2.5-flash-exp", "g25f-exp"),
        ("claude-3.5-sonnet", "claude-35-sonnet"), ("openai:gpt-4.0", "gpt-40"), ("gemini", "gg"), ("gemini-ultra", "gg-ultra"), ("::", "model"), (None, None),
    ],
)
def test_shortcodes(spark, model, code):
    assert values(spark, [model], ident.model_shortcode) == [code]


def test_tags(spark):
    assert values(spark, ["gemini-3.5-flash-lite"], lambda c: ident.lyrics_tag(c, 9)) == ["g35l-09"]
    assert values(spark, ["claude-3.5-sonnet"], lambda c: ident.subtitles_tag(c, 1, 3)) == ["claude-35-sonnet-0103"]


def test_names_and_hashes(spark):
    assert values(spark, ["w/part_001.mp4", "part_1000.mp4", "Part_001.mp4", None, "part_001.tar.gz"], ident.is_managed) == [True, False, False, False, False]
    assert values(spark, ["/a/reencoded/part_001.mov", "/a/b/x.mp4"], ident.unique_display_name) == ["a/part_001.mov", "b/x.mp4"]
    import base64
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    forms = [h, h.upper(), base64.b64encode(h.encode()).decode(), base64.b64encode(bytes.fromhex(h)).decode(), None, "", "nonsense"]
    assert values(spark, forms, lambda c: ident.hashes_match(c, F.lit(h))) == [True] * 4 + [False] * 3
    assert values(spark, forms, ident.hash_key) == [h] * 4 + [None] * 3


def test_media(spark):
    assert values(spark, ["300.0459", "x", None], media.duration_ms) == [300045, None, None]
    assert values(spark, ["30000/1001", "25", "0/0", "5/", "x", None], media.frame_rate) == [30000 / 1001, 25.0, None, None, None, None]
    fps = spark.createDataFrame([(0.3,), (1.0,), (30.0,), (None,)], "x double")
    assert [r[0] for r in fps.select(media.tolerance_ms(100, F.col("x"))).collect()] == [3433, 100, 100, 100]
    n = spark.createDataFrame([(1000, 1199, 2), (1000, 1200, 2), (None, 1, 1)], "a int, b int, n int")
    assert [r[0] for r in n.select(media.split_reusable(F.col("a"), F.col("b"), F.col("n"), 100)).collect()] == [True, False, None]
    size = spark.createDataFrame([(20 << 20,), ((20 << 20) - 1,)], "s bigint")
    assert [tuple(r) for r in size.select(media.at_least_mib(F.col("s"), 20), media.at_least_mib(F.col("s"), 0)).collect()] == [(True, True), (False, True)]
    same = fps.limit(1).select(media.same_stream(F.lit(1000), F.lit(1099), F.lit(1.0), F.lit(1.005), F.lit(100)), media.bits_per_second(F.lit(35)))
    assert tuple(same.first()) == (True, 286720)


def test_seconds_are_rounded_as_binary_numbers(spark):
    ms = [*range(0, 3000, 50), 302_150, 299_950, 123_450, 60_049, 60_051, 10**9 + 350]
    df = spark.createDataFrame([(x,) for x in ms], "x bigint")
    assert [r[0] for r in df.select(seconds(F.col("x"))).collect()] == [f"{x / 1000:.1f}" for x in ms]
