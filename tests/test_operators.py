import random

from pyspark.sql import functions as F

from cuemill.backend import BatchBackend, ReplayBackend
from cuemill.operators import gaps, policy, prefix, retain, search, segments, validate
from cuemill.operators.prompt import scenes_json, verification_prompt
from cuemill.operators.stitch import PLACEHOLDER, headed, stitch


def fold(cues, duration, threshold):
    """The sequential rule: list order, latest end so far."""
    if not cues:
        return duration >= threshold
    if cues[0][0] >= threshold:
        return True
    end = cues[0][1]
    for s, e in cues[1:]:
        if s - end >= threshold:
            return True
        end = max(end, e)
    return duration - end >= threshold


def test_gaps_window_and_nested_agree_with_the_fold(spark):
    rng = random.Random(5)
    lists = {f"s{i}": [(rng.randrange(0, 300), rng.randrange(0, 300)) for _ in range(rng.randrange(0, 6))] for i in range(60)}
    lists["no gap"] = [(0, 100), (10, 20), (110, 120)]
    spans = spark.createDataFrame([(k, 300 if k != "no gap" else 125) for k in lists], "segment_name string, duration_ms bigint")
    flat = spark.createDataFrame([(k, p, s, e) for k, v in lists.items() for p, (s, e) in enumerate(v)], "segment_name string, pos int, start_ms bigint, end_ms bigint")
    want = {k: fold(v, 300 if k != "no gap" else 125, 60) for k, v in lists.items()}
    got = gaps.largest_gaps(flat, spans).select("segment_name", gaps.has_large_gap(60))
    assert dict(map(tuple, got.collect())) == want
    nested = spark.createDataFrame([(k, 300 if k != "no gap" else 125, v) for k, v in lists.items()], "k string, d bigint, cues array<struct<start_ms:bigint,end_ms:bigint>>")
    assert dict(map(tuple, nested.select("k", gaps.has_large_gap_nested(F.col("cues"), F.col("d"), 60)).collect())) == want


def test_response_is_rejected_as_a_whole(spark):
    rows = [("a", 0, 0, 10), ("a", 1, 10, 10), ("a", 2, None, 5), ("b", 0, 0, 1002), ("c", 0, 0, 1003), ("d", 0, 0, 10**9)]
    df = spark.createDataFrame([(*r, None if r[0] == "d" else 1000, "x") for r in rows], "k string, pos int, start_ms bigint, end_ms bigint, duration_ms bigint, reason string")
    got = {r[0]: tuple(r[1:]) for r in validate.response_verdicts(df, ["k"], buffer_ms=2).collect()}
    assert got == {"a": (3, 1, "order"), "b": (1, None, None), "c": (1, 0, "beyond"), "d": (1, None, None)}


def test_stitch_shifts_numbers_and_fills(spark):
    seg = spark.createDataFrame([("m", 0, "a", 100), ("m", 1, "b", 50), ("m", 2, "c", 70), ("n", 0, "z", 5)], "media_id string, seg_idx int, segment_name string, duration_ms bigint")
    cues = spark.createDataFrame([("a", 0, 0, 5, "x"), ("a", 1, 3, 9, None), ("c", 4, 1, 2, "y")], "segment_name string, pos int, start_ms bigint, end_ms bigint, text string")
    got = sorted(map(tuple, stitch(seg, cues).select("media_id", "cue_no", "start_ms", "end_ms", "text").collect()), key=str)
    assert got == [("m", 1, 1, 5, "x"), ("m", 2, 3, 9, None), ("m", 3, 100, 150, PLACEHOLDER), ("m", 4, 151, 152, "y"), ("n", 1, 1, 5, PLACEHOLDER)]


def test_segments(spark):
    seg = spark.createDataFrame([("m", i, f"s{i}", 100 + i) for i in range(4)], "media_id string, seg_idx int, segment_name string, duration_ms bigint")
    assert [r.offset_ms for r in segments.offsets(seg).orderBy("seg_idx").collect()] == [0, 100, 201, 303]
    assert segments.skip_start(seg, 7.0, 300).count() == 3
    assert [(r.is_first, r.is_last) for r in segments.boundary_flags(seg).orderBy("seg_idx").collect()] == [(True, False), (False, False), (False, False), (False, True)]
    twice = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), (None, 3, 7)], "k string, loaded_at int, v int")
    assert sorted(map(tuple, segments.latest(twice, "k").collect()), key=str) == [("k", 2, 6), (None, 3, 7)]


def test_eviction_is_the_greedy_loop(spark):
    rng = random.Random(9)
    for cap in (0, 3000, 10_000, 10**9):
        files = [(f"f{i:03}", rng.choice(["part_001.mp4", "other.mp4", None]), rng.choice([None, rng.randrange(1000)]), rng.choice([None, f"2025-01-0{rng.randrange(1, 9)} 10:00:00"]), f"2025-02-0{rng.randrange(1, 9)} 09:00:00") for i in range(60)]
        df = spark.createDataFrame(files, "remote_name string, display_name string, size_bytes bigint, e string, c string").select("*", F.col("e").cast("timestamp").alias("expiration_time"), F.col("c").cast("timestamp").alias("create_time"))
        total, want = sum(f[2] or 0 for f in files), []
        for f in sorted((f for f in files if f[1] == "part_001.mp4"), key=lambda f: (f[3] or f[4], f[0])):
            if total + 100 <= cap:
                break
            total -= f[2] or 0
            want.append(f[0])
        assert sorted(r.remote_name for r in retain.evict(df, 100, capacity=cap).collect()) == sorted(want)


def test_reuse_takes_the_first_and_passes_failed_over(spark):
    h = "ab" * 32
    remote = spark.createDataFrame([("r1", "x.mp4", 5, h, "FAILED"), ("r2", "d/x.mp4", 5, h.upper(), "ACTIVE"), ("r3", "x.mp4", 5, h, "ACTIVE"), ("r4", "x.mp4", None, None, "ACTIVE")], "remote_name string, display_name string, size_bytes bigint, sha256_hash string, state string")
    local = spark.createDataFrame([("x.mp4", "d/x.mp4", 5, h), ("x.mp4", "d/x.mp4", 6, h)], "file_name string, display_name string, size_bytes bigint, sha256_hex string")
    assert [tuple(r) for r in retain.reusable(local, remote).collect()] == [("x.mp4", "d/x.mp4", "r2")]


def test_search(spark):
    ok = ("t", "u", "c" * 4096)
    df = spark.createDataFrame([ok, ("t", "u", "c" * 4097), ("", "u", "c"), (None, "u", "c"), ("t", "u", "")], "title string, url string, content string")
    assert search.usable(df).count() == 1
    raw = spark.createDataFrame([('{"results":[{"title":"a","url":"b","content":"c"}]}',), ("junk",), (None,)], "x string")
    assert [r[0] for r in raw.select(search.map_payload(F.col("x"), "ollama")).collect()] == [[("a", "b", "c")], [], []]
    q = spark.createDataFrame([("Hello, world!",), ("hello world",), (None,)], "query string")
    assert [tuple(r) for r in search.distinct_queries(q, "query").collect()] == [("hello world", "Hello, world!", 2)]


def test_policy(spark):
    assert [r.wait_s for r in policy.backoff_schedule(spark, 5, 30.0, 2.0, 300.0).collect()] == [30, 60, 120, 240, 300]
    df = spark.createDataFrame([(429, "x GenerateFree y"), (429, None), (500, "generatefree")], "s int, b string")
    assert [r[0] for r in df.select(policy.quota_exceeded(F.col("s"), F.col("b"), "generateFREE")).collect()] == [True, False, False]
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "hit"), ("a", 3, "ok"), ("b", 1, "ok")], "k string, t int, x string")
    assert sorted(map(tuple, policy.latched(log, "k", ["t"], F.col("x") == "hit").collect())) == [("a", 3, 2, 1), ("b", 1, 1, 0)]


def test_prompts_and_backends(spark):
    df = spark.createDataFrame([([("x", None)],), (None,)], "s array<struct<a:string,b:string>>")
    assert [r[0] for r in df.select(scenes_json(F.col("s"))).collect()] == ['[{"a":"x","b":null}]', "null"]
    assert "12.3 seconds" in df.select(verification_prompt(F.lit("p"), F.lit(12_345))).first()[0]
    asked = spark.createDataFrame([("1", "p"), ("2", "q")], "request_id string, prompt string")
    recorded = spark.createDataFrame([("1", "r")], "request_id string, response string")
    assert sorted(map(tuple, ReplayBackend(recorded).run(asked).collect())) == [("1", "r"), ("2", None)]

    def shout(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_upper(b.column(1))], ["request_id", "response"])

    assert sorted(map(tuple, BatchBackend(shout, 2).run(asked).collect())) == [("1", "P"), ("2", "Q")]


def test_sums_before_go_over_blocks(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(prefix, "BLOCK", 16)
    rows = [("hot" if i < 300 else rng.choice(["a", None]), i, rng.choice([None, rng.randrange(9)]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int, _key string")
    got = {(r.k, r.i): r.s for r in prefix.sums_before(df, "k", "i", {"s": "v"}).collect()}
    assert got == {(k, i): sum(w or 0 for q, j, w, _ in rows if q == k and j < i) for k, i, _, _ in rows}
    ranged = {r.i: r.s for r in prefix.running_before(df, ["i"], "v", "s").collect()}
    assert ranged == {i: sum(w or 0 for _, j, w, _ in rows if j < i) for _, i, _, _ in rows}
    assert prefix.sums_before(df.limit(0), "k", "i", {"s": "v"}).collect() == [] and prefix.running_before(df.limit(0), ["i"], "v", "s").collect() == []


def test_results_of_a_query_and_its_cache(spark):
    rows = [(10 + p, "q", p, f"t{p}", "u", "c", p) for p in range(1, 11)] + [(99, "q", 3, "later", "u", "c", 1), (12, "q", 2, "t2", "u", "c", 7), (30, "Q!", 1, None, "u", "c", 0), (31, "other", 1, "t", "u", "c" * 5000, 0), (32, None, 1, "t", "u", "c", 0), (33, "q", 11, "t", "u", "c", 0), (34, "q", None, "t", "u", "c", 0)]
    df = spark.createDataFrame(rows, "result_id bigint, search_query string, pos int, title string, url string, content string, at int").selectExpr("*", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, at) made_at", "1 results", "2 query_key")
    lists = search.grouped(df)
    got = {r.search_query: [x.title for x in r.results] for r in lists.collect()}
    assert got == {"q": [f"t{p}" for p in range(1, 11)], "Q!": [], "other": []}
    seen = {r.search_query: (r.query_key, r.sent, r.n_results) for r in search.through_cache(df, lists).collect()}
    assert seen == {"q": ("q", False, 0), "Q!": ("q", True, 0), "other": ("other", True, 0)}
    assert search.grouped(df.limit(0)).collect() == [] and search.through_cache(df.limit(0), lists).collect() == []


def test_stored_responses_are_loaded_or_not(spark):
    rows = [("good", 0, 0, 0, 5), ("good", 1, 0, 1, 9), ("early", 0, 0, 0, 10**6), ("early", 1, 0, 0, 5), ("late", 0, 0, 0, 5), ("late", 1, 0, 0, 10**6), ("order", 0, 2, 5, 5), ("order", 1, 0, 0, 5), ("bad", 0, 0, None, 5)]
    df = spark.createDataFrame([(*r, 100, "x") for r in rows], "segment_name string, attempt int, pos int, start_ms bigint, end_ms bigint, duration_ms bigint, reason string")
    got = {r.segment_name: (r.n_responses, r.reason) for r in validate.load_verdicts(df).collect()}
    assert got == {"good": (2, None), "early": (2, None), "late": (2, "beyond"), "order": (2, "order"), "bad": (1, "unreadable")}
    assert validate.load_verdicts(df.limit(0)).collect() == []


def test_complete(spark):
    cases = [(0, True, False, True, True), (1, False, False, True, True), (1, True, True, False, False), (2, True, True, False, False), (1, True, True, True, False), (1, True, True, False, True), (1, True, False, False, False)]
    df = spark.createDataFrame(cases, "n int, loaded boolean, gap boolean, a boolean, b boolean")
    args = [F.col(c) for c in ("n", "loaded", "gap", "a", "b")]
    assert [r[0] for r in df.select(gaps.complete(*args)).collect()] == [False, False, False, True, True, True, True]
    assert [r[0] for r in df.select(gaps.complete(*args, retries=0)).collect()] == [False, False, True, True, True, True, True]
    assert [r[0] for r in df.select(gaps.complete(*args, ignore_start=False, ignore_end=False)).collect()] == [False, False, False, True, False, False, True]


def test_the_header_stands_in_front(spark):
    df = spark.createDataFrame([("m", 0, 0, 1, 1, 5, "x"), ("m", 0, 1, 2, 6, 7, None), (None, 0, 0, 1, 1, 2, "y")], "media_id string, seg_idx int, pos int, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    got = sorted(((r.media_id, r.cue_no, r.start_ms, r.end_ms, r.text) for r in headed(df, F.lit("{a}")).collect()), key=str)
    assert got == sorted([("m", 0, 0, 1, "(a)"), ("m", 1, 1, 5, "x"), ("m", 2, 6, 7, None), (None, 0, 0, 1, "(a)"), (None, 1, 1, 2, "y")], key=str)
