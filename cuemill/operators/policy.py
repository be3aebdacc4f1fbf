"""Rates, waits and quotas: as expressions and as analyses of request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: tokens counted for a second of video.
TOKENS_PER_SECOND = 300
RETRYABLE = (429, 500, 502, 503, 504)


def estimated_tokens(system: Column, user: Column, duration_ms: Column) -> Column:
    return F.floor(F.length(system) + F.length(user) + duration_ms / 1000 * TOKENS_PER_SECOND).cast("bigint")


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def quota_exceeded(status: Column, body: Column, marker: str) -> Column:
    return F.coalesce((status == 429) & F.contains(F.lower(body), F.lit(marker.lower())), F.lit(False))


def backoff_seconds(attempt: Column, least: float, factor: float, most: float, jitter: Column | None = None) -> Column:
    wait = F.lit(least) * F.pow(F.lit(factor), attempt)
    return F.least(F.lit(most), wait + jitter if jitter is not None else wait)


def backoff_schedule(spark: SparkSession, retries: int, least: float, factor: float, most: float) -> DataFrame:
    """``attempt, wait_s, total_s`` without jitter; ``retries`` rows."""
    s = spark.range(retries, numPartitions=1).select(F.col("id").cast("int").alias("attempt"), backoff_seconds(F.col("id"), least, factor, most).alias("wait_s"))
    return s.withColumn("total_s", F.sum("wait_s").over(Window.orderBy("attempt")))


def rate_window(qps: Column) -> tuple[Column, Column]:
    """(requests, seconds) of the limiter's window for a rate per second."""
    return F.when(qps < 1, 1).otherwise(F.floor(qps)).cast("int"), F.when(qps < 1, F.ceil(1 / qps)).otherwise(1).cast("int")


def window_breaches(log: DataFrame, key: str, ts: str, weight: str, width: str, request_cap: int, weight_cap: float) -> DataFrame:
    """Tumbling windows per key with their requests and weights, and whether either cap is exceeded."""
    w = log.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n_requests"), F.sum(weight).alias("sum_weight"))
    return w.select(key, F.col("w.start").alias("window_start"), "n_requests", "sum_weight", ((F.col("n_requests") > request_cap) | (F.col("sum_weight") > weight_cap)).alias("breach"))


def latched(log: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """Per key: ``n_requests``, ``n_before`` the first hit (inclusive) and ``n_latched`` behind it, which would have failed at once.
    The first hit is an aggregate joined back, not a running window."""
    first = log.where(hit).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    j = log.join(first, key, "left").withColumn("_late", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False)))
    return j.groupBy(key).agg(F.count("*").alias("n_requests"), F.count(F.when(~F.col("_late"), 1)).alias("n_before"), F.count(F.when(F.col("_late"), 1)).alias("n_latched"))
