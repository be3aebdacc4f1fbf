"""Queries on stored files, search results, models and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident, media
from ..operators import policy, retain, search, segments
from ..session import table
from ..settings import Settings, masked_json


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "remote_file").distinct()


def managed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remote(spark, sf_dir).select("remote_name", "display_name", ident.is_managed(F.col("display_name")).alias("managed"))


def hash_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes in one spelling, and whether the comparison agrees with it."""
    r = _remote(spark, sf_dir).withColumn("hash_hex", ident.hash_key(F.col("sha256_hash")))
    return r.select("remote_name", "hash_hex", ident.hashes_match(F.col("sha256_hash"), F.col("hash_hex")).alias("matches"))


def hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local files made from the stored ones, every other one with a changed size, looked up by content."""
    r = _remote(spark, sf_dir).where("display_name is not null and size_bytes is not null").withColumn("sha256_hex", ident.hash_key(F.col("sha256_hash"))).where("sha256_hex is not null")
    number = F.regexp_extract("remote_name", r"(\d+)$", 1).cast("bigint")
    local = r.select(
        F.substring_index("display_name", "/", -1).alias("file_name"),
        ident.unique_display_name(F.concat(F.lit("/data/vx-hotline0/reencoded/"), F.substring_index("display_name", "/", -1))).alias("display_name"),
        (F.col("size_bytes") + F.when(number % 2 == 1, 1).otherwise(0)).alias("size_bytes"),
        F.upper("sha256_hex").alias("sha256_hex"),
    )
    return retain.reusable(local, _remote(spark, sf_dir))


def evict_to_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain.evict(_remote(spark, sf_dir), required_bytes=1000, capacity_share=0.5)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_result").select("result_id", "search_query", "search_tool", "pos", "title", "url", "content").distinct()


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.usable(_results(spark, sf_dir)).select("result_id", "title", "url", F.length("content").cast("bigint").alias("content_length"))


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results wrapped into both services' payloads and mapped back."""
    r = _results(spark, sf_dir)
    raw = F.when(F.col("search_tool") == "langsearch", F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("title").alias("name"), "url", F.col("content").alias("summary"))).alias("value")).alias("webPages")).alias("data")))).otherwise(
        F.to_json(F.struct(F.array(F.struct("title", "url", "content")).alias("results")))
    )
    mapped = F.when(F.col("search_tool") == "langsearch", search.map_payload(raw, "langsearch")).otherwise(search.map_payload(raw, "ollama"))
    return r.select("result_id", F.inline(mapped))


def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distinct_queries(_results(spark, sf_dir), "search_query")


def _told(results: Column) -> Column:
    """A list of results as text: fields parted by chr(31), results by chr(30)."""
    return F.array_join(F.transform(results, lambda x: F.concat_ws("\x1f", x["title"], x["url"], x["content"])), "\x1e")


def results_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with all its usable results, ten at most."""
    return search.grouped(_results(spark, sf_dir)).select("search_query", "n_results", _told(F.col("results")).alias("results"))


def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with what it gets through the cache by normalised query."""
    asked = table(spark, sf_dir, "search_result").select("search_query", "made_at")
    c = search.through_cache(asked, search.grouped(_results(spark, sf_dir)))
    return c.select("search_query", "query_key", "sent", "n_results", _told(F.col("results")).alias("results"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", policy.estimated_tokens(F.lit("x" * 100), F.coalesce("text", F.lit("")), F.col("doc_id") % 300_000).alias("tokens"))


def window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    b = policy.window_breaches(e, "event_type", "ts", "cents", "1 hour", 4, 100_000)
    return b.select("event_type", F.unix_seconds("window_start").alias("window_s"), "n_requests", "sum_weight", "breach")


def quota_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return policy.latched(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = policy.backoff_schedule(spark, 5, 30.0, 2.0, 300.0).select(F.lit("agent").alias("policy"), "*")
    return a.unionByName(policy.backoff_schedule(spark, 3, 1.0, 2.0, 10.0).select(F.lit("search").alias("policy"), "*"))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, seconds = policy.rate_window(F.col("qps"))
    return spark.createDataFrame([(0.3,), (0.7,), (1.0,), (1.9,), (3.0,)], "qps double").select("qps", requests.alias("requests"), seconds.alias("seconds"))


def retry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service: which may be asked again, and which say that a quota is used up."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (F.col("event_id") % len(STATUSES) + 1).cast("int"))
    s = e.select("event_id", status.alias("status"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Quota per DAY used up: "), "event_type")).alias("body"))
    return s.select("event_id", "status", policy.is_retryable(F.col("status")).alias("retryable"), policy.quota_exceeded(F.col("status"), F.col("body"), "per day").alias("quota"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.sha256_hex(F.col("text")).alias("sha256"))


def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a probe would say of each segment, read back: duration, frame rate and tolerance."""
    s = table(spark, sf_dir, "segment").select("segment_name", "seg_idx", "duration_ms").distinct()
    rate = F.element_at(F.array(*[F.lit(x) for x in ("30000/1001", "25", "1/2", "0/0")]), (F.col("seg_idx") % 4 + 1).cast("int"))
    p = s.select("segment_name", "duration_ms", F.concat(F.floor(F.col("duration_ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("duration_ms") % 1000).cast("string"), 3, "0"), F.lit("9")).alias("seconds"), media.frame_rate(rate).alias("fps"))
    return p.select(
        "segment_name", media.duration_ms(F.col("seconds")).alias("probed_ms"), "fps", media.tolerance_ms(100, F.col("fps")).alias("tolerance_ms"), media.key_frame_distance(F.col("fps")).alias("key_frames"), media.at_least_mib(F.col("duration_ms") * 70, 20.0).alias("large")
    )


def reencode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment against a stored re-encoding whose duration and frame rate are off by some amount: may it be used again?"""
    s = table(spark, sf_dir, "segment").select("segment_name", "seg_idx", "duration_ms").distinct()
    fps = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.5, 25.0)]), (F.col("seg_idx") % 3 + 1).cast("int"))
    other = F.element_at(F.array(F.lit(0.0), F.lit(0.004), F.lit(0.02), F.lit(None).cast("double")), (F.col("seg_idx") % 4 + 1).cast("int"))
    off = F.element_at(F.array(*[F.lit(x) for x in (0, 99, 100, -101, 2099, 2100)]), (F.col("seg_idx") % 6 + 1).cast("int"))
    p = s.select("segment_name", "duration_ms", fps.alias("fps"), (fps + other).alias("other_fps"), (F.col("duration_ms") + off).alias("other_ms"))
    rate = (F.col("fps") * 35).cast("int")
    return p.select("segment_name", media.same_stream(F.col("duration_ms"), F.col("other_ms"), F.col("fps"), F.col("other_fps"), media.tolerance_ms(100, F.col("fps"))).alias("reusable"), media.bits_per_second(rate).alias("bits"), media.buffer_bits(rate).alias("buffer"))


def split_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored segments still make up each medium, whose length is off by some seconds."""
    s = segments.latest(table(spark, sf_dir, "segment"), "segment_name").where("media_id is not null")
    t = segments.media_totals(s, 100)
    whole = F.col("total_ms") + F.pmod(F.length("media_id") * 97 + F.col("n_segments") * 13, F.lit(4)) * 50 * F.col("n_segments")
    return t.select("media_id", "n_segments", media.split_reusable(F.col("total_ms"), whole, F.col("n_segments"), 100).alias("reusable"))


STATUSES = (200, 404, 429, 500, 501, 502, 503, 504)
#: Model names in the forms that occur; combined with the parts below.
PREFIXES, TIERS, SUFFIXES = ("google-gla:gemini-", "gemini-", "openai:gpt-", "claude-"), ("flash-lite", "flash", "pro", "ultra"), ("", "-preview", "-exp", "_001")


def shortcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")

    def pick(values, step):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / step) % len(values) + 1).cast("int"))

    model = F.concat(pick(PREFIXES, 1), (F.col("p_partkey") % 4 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("-"), pick(TIERS, 4), pick(SUFFIXES, 16))
    m = part.select("p_partkey", model.alias("model"))
    return m.select("p_partkey", "model", ident.model_shortcode(F.col("model")).alias("code"), ident.lyrics_tag(F.col("model"), 9).alias("lyrics_tag"), ident.subtitles_tag(F.col("model"), 9, 18).alias("subtitles_tag"), ident.is_google(F.col("model")).alias("is_google"))


def settings_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a stitched file: settings without secrets and paths, braces made parentheses."""
    return spark.createDataFrame([(masked_json(Settings()).replace("{", "(").replace("}", ")"),)], "header string")


QUERIES = {
    "managed_names": managed_names,
    "hash_spellings": hash_spellings,
    "hash_reuse": hash_reuse,
    "evict_to_capacity": evict_to_capacity,
    "search_filter": search_filter,
    "search_payloads": search_payloads,
    "query_keys": query_keys,
    "results_by_query": results_by_query,
    "cached_results": cached_results,
    "retry_kinds": retry_kinds,
    "content_hash": content_hash,
    "token_estimate": token_estimate,
    "window_limits": window_limits,
    "quota_latch": quota_latch,
    "backoff": backoff,
    "rate_windows": rate_windows,
    "shortcodes": shortcodes,
    "media_probe": media_probe,
    "reencode_check": reencode_check,
    "split_reuse": split_reuse,
    "settings_mask": settings_mask,
}

_R = "f AS (SELECT DISTINCT * FROM remote_file)"
_HEX = """CASE WHEN regexp_full_match(sha256_hash, '[0-9a-fA-F]{64}') THEN lower(sha256_hash)
 WHEN length(sha256_hash) = 88 THEN lower(decode(from_base64(sha256_hash))) WHEN length(sha256_hash) = 44 THEN lower(hex(from_base64(sha256_hash))) END"""
_MANAGED = "coalesce(regexp_full_match(split_part(display_name, '/', -1), 'part_\\d{3}\\.[^./]+'), false)"
_RES = "s AS (SELECT DISTINCT result_id, search_query, search_tool, pos, title, url, content FROM search_result)"
_P = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


_LISTS = """r AS (SELECT search_query, pos, arg_min(concat_ws(chr(31), title, url, content), result_id) FILTER (WHERE title <> '' AND url <> '' AND content <> '' AND length(content) <= 4096 AND pos BETWEEN 1 AND 10) AS x FROM s WHERE search_query IS NOT NULL GROUP BY search_query, pos),
g AS (SELECT search_query, count(x) AS n_results, coalesce(string_agg(x, chr(30) ORDER BY pos), '') AS results FROM r GROUP BY search_query)"""


def _pick(values: tuple[str, ...], step: int) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[(p_partkey // {step}) % {len(values)} + 1]"


def _safe(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace({c}, '.', ''), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_CODE = f"""CASE WHEN prefix LIKE '%gemini-' THEN 'g' || a || b || (CASE tier WHEN 'flash-lite' THEN 'l' WHEN 'flash' THEN 'f' WHEN 'pro' THEN 'p' ELSE 'g' END)
 || (CASE WHEN tier = 'ultra' THEN '-' || {_safe("tier || suffix")} WHEN suffix = '-preview' THEN 'p' WHEN suffix = '' THEN '' ELSE '-' || {_safe("suffix")} END)
 ELSE {_safe("split_part(prefix, ':', -1) || a || '.' || b || '-' || tier || suffix")} END"""

SQL = {
    "managed_names": f"WITH {_R} SELECT remote_name, display_name, {_MANAGED} AS managed FROM f",
    "hash_spellings": f"WITH {_R}, h AS (SELECT remote_name, {_HEX} AS hash_hex FROM f) SELECT remote_name, hash_hex, hash_hex IS NOT NULL AS matches FROM h",
    "hash_reuse": f"""WITH {_R}, h AS (SELECT *, {_HEX} AS hx, regexp_extract(remote_name, '(\\d+)$', 1)::BIGINT AS no, split_part(display_name, '/', -1) AS fname FROM f),
l AS (SELECT fname AS file_name, 'vx-hotline0/' || fname AS display_name, size_bytes + no % 2 AS size_bytes, hx FROM h WHERE hx IS NOT NULL AND display_name IS NOT NULL AND size_bytes IS NOT NULL)
SELECT l.file_name, l.display_name, min(h.remote_name) AS remote_name FROM l JOIN h ON h.size_bytes = l.size_bytes AND h.hx = l.hx AND h.display_name IN (l.file_name, l.display_name) AND upper(h.state) <> 'FAILED' GROUP BY 1, 2""",
    "evict_to_capacity": f"""WITH {_R}, t AS (SELECT sum(coalesce(size_bytes, 0))::BIGINT AS total FROM f),
m AS (SELECT remote_name, size_bytes, coalesce(sum(coalesce(size_bytes, 0)) OVER (ORDER BY coalesce(expiration_time, create_time) ASC NULLS FIRST, remote_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM f WHERE {_MANAGED})
SELECT remote_name, size_bytes FROM m, t WHERE total - before + 1000 > floor(total * 0.5::DOUBLE)::BIGINT""",
    "search_filter": f"WITH {_RES} SELECT result_id, title, url, length(content) AS content_length FROM s WHERE title <> '' AND url <> '' AND content <> '' AND length(content) <= 4096",
    "search_payloads": f"WITH {_RES} SELECT result_id, title, url, content FROM s",
    "query_keys": f"WITH {_RES} SELECT replace(lower(translate(search_query, '{_P}', '')), 'ß', 'ss') AS query_key, min(search_query) AS query, count(*) AS n_queries FROM s WHERE search_query IS NOT NULL GROUP BY 1",
    # a service's payload has ten results; those without title, url or content, or with over 4,096 characters, are dropped
    "results_by_query": f"WITH {_RES}, {_LISTS} SELECT search_query, n_results, results FROM g",
    "cached_results": f"""WITH {_RES}, {_LISTS}, a AS (SELECT search_query, min(made_at) AS asked FROM search_result WHERE search_query IS NOT NULL GROUP BY search_query),
k AS (SELECT *, replace(lower(translate(search_query, '{_P}', '')), 'ß', 'ss') AS query_key FROM a),
f AS (SELECT *, first_value(search_query) OVER (PARTITION BY query_key ORDER BY asked NULLS LAST, search_query) AS first_query FROM k)
SELECT f.search_query, query_key, f.search_query = first_query AS sent, n_results, results FROM f JOIN g ON g.search_query = first_query""",
    "retry_kinds": """WITH s AS (SELECT event_id, ([200, 404, 429, 500, 501, 502, 503, 504])[event_id % 8 + 1]::INT AS status, event_id % 2 = 0 AS told FROM events)
SELECT event_id, status, status IN (429, 500, 502, 503, 504) AS retryable, status = 429 AND told AS quota FROM s""",
    "reencode_check": """WITH s AS (SELECT DISTINCT segment_name, duration_ms, ([1.0::DOUBLE, 0.5, 25.0])[seg_idx % 3 + 1] AS fps, ([0.0::DOUBLE, 0.004, 0.02, NULL])[seg_idx % 4 + 1] AS other, ([0, 99, 100, -101, 2099, 2100])[seg_idx % 6 + 1] AS off FROM segment)
SELECT segment_name, coalesce(abs(off) < 100 + CASE WHEN fps < 1 THEN 2000 ELSE 0 END AND abs(fps - (fps + other)) < 0.01, false) AS reusable, (trunc(fps * 35) * 8192)::INT AS bits, (trunc(fps * 35) * 16384)::INT AS buffer FROM s WHERE duration_ms IS NOT NULL
UNION ALL SELECT segment_name, false, (trunc(fps * 35) * 8192)::INT, (trunc(fps * 35) * 16384)::INT FROM s WHERE duration_ms IS NULL""",
    "split_reuse": """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_name ORDER BY loaded_at DESC) AS rn FROM segment) WHERE rn = 1 AND media_id IS NOT NULL)
SELECT media_id, count(*) AS n_segments, ((length(media_id) * 97 + count(*) * 13) % 4) * 50 < 100 AS reusable FROM d GROUP BY media_id""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "token_estimate": "SELECT doc_id, floor(100 + length(coalesce(text, '')) + (doc_id % 300000) / 1000.0::DOUBLE * 300)::BIGINT AS tokens FROM documents",
    "window_limits": "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS window_s, count(*) AS n_requests, sum(round(value * 100)::BIGINT)::BIGINT AS sum_weight, count(*) > 4 OR sum(round(value * 100)::BIGINT) > 100000 AS breach FROM events GROUP BY 1, 2",
    "quota_latch": "WITH k AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS late FROM events) SELECT user_id, count(*) AS n_requests, count(*) FILTER (WHERE NOT late) AS n_before, count(*) FILTER (WHERE late) AS n_latched FROM k GROUP BY user_id",
    "backoff": """SELECT policy, attempt, wait_s, sum(wait_s) OVER (PARTITION BY policy ORDER BY attempt) AS total_s FROM (
SELECT 'agent' AS policy, i::INT AS attempt, least(300.0, 30.0 * 2 ** i)::DOUBLE AS wait_s FROM range(5) t(i) UNION ALL SELECT 'search', i::INT, least(10.0, 1.0 * 2 ** i)::DOUBLE FROM range(3) t(i))""",
    "rate_windows": "SELECT qps, CASE WHEN qps < 1 THEN 1 ELSE floor(qps) END::INT AS requests, CASE WHEN qps < 1 THEN ceil(1 / qps) ELSE 1 END::INT AS seconds FROM (VALUES (0.3::DOUBLE), (0.7), (1.0), (1.9), (3.0)) t(qps)",
    "media_probe": """WITH s AS (SELECT DISTINCT segment_name, duration_ms, (ARRAY[30000 / 1001.0::DOUBLE, 25.0::DOUBLE, 0.5::DOUBLE, NULL])[seg_idx % 4 + 1] AS fps FROM segment)
SELECT segment_name, trunc((duration_ms // 1000 || '.' || lpad((duration_ms % 1000)::VARCHAR, 3, '0') || '9')::DOUBLE * 1000)::BIGINT AS probed_ms, fps, 100 + CASE WHEN fps < 1 THEN floor(1000 / fps)::BIGINT ELSE 0 END AS tolerance_ms, floor(fps * 10)::INT AS key_frames, duration_ms * 70 / 1048576.0::DOUBLE >= 20.0 AS large FROM s""",
    "shortcodes": f"""WITH m AS (SELECT p_partkey, {_pick(PREFIXES, 1)} AS prefix, (p_partkey % 4 + 1)::VARCHAR AS a, (p_partkey % 7)::VARCHAR AS b, {_pick(TIERS, 4)} AS tier, {_pick(SUFFIXES, 16)} AS suffix FROM part),
k AS (SELECT p_partkey, prefix || a || '.' || b || '-' || tier || suffix AS model, {_CODE} AS code FROM m)
SELECT p_partkey, model, code, code || '-09' AS lyrics_tag, code || '-0918' AS subtitles_tag, lower(model) LIKE 'google-gla%' AS is_google FROM k""",
}
