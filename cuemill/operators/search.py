"""Search results: mapping of payloads, filtering, caching by query, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_query

#: Schemas of the two services' payloads.
PAYLOADS = {
    "langsearch": "data struct<webPages:struct<value:array<struct<name:string,url:string,summary:string>>>>",
    "ollama": "results array<struct<title:string,url:string,content:string>>",
}


def map_payload(payload: Column, service: str) -> Column:
    """``array<struct<title, url, content>>`` of a raw JSON payload; empty where nothing can be read."""
    p = F.from_json(payload, PAYLOADS[service])
    raw = p["data"]["webPages"]["value"] if service == "langsearch" else p["results"]
    names = ("name", "url", "summary") if service == "langsearch" else ("title", "url", "content")
    out = F.transform(raw, lambda r: F.struct(*[r[a].alias(b) for a, b in zip(names, ("title", "url", "content"))]))
    return F.coalesce(out, F.array().cast("array<struct<title:string,url:string,content:string>>"))


def usable(df: DataFrame, max_length: int = 4096) -> DataFrame:
    """Results with a title, url and content, none of them empty, and a content of at most ``max_length`` characters; longer
    ones are dropped, not cut."""
    return df.where((F.col("title") != "") & (F.col("url") != "") & (F.col("content") != "") & (F.length("content") <= max_length))


def distinct_queries(df: DataFrame, query: str) -> DataFrame:
    """``query_key, query, n_queries``: each normalised query once, with the spelling that would be sent: every query is
    searched once and its result joined back."""
    return df.where(F.col(query).isNotNull()).groupBy(normalise_query(F.col(query)).alias("query_key")).agg(F.min(query).alias("query"), F.count("*").alias("n_queries"))


def grouped(results: DataFrame, query: str = "search_query", pos: str = "pos", most: int = 10, first: int = 1, max_length: int = 4096) -> DataFrame:
    """``query, n_results, results``: each query as it was put, with its usable results (see ``usable``) in order of position, as
    ``array<struct<title, url, content>>``. Positions count from ``first``; of a service ``most`` results are requested, which
    bounds each list. Where a position was delivered more than once the result with the least ``result_id`` counts. A query whose results are all unusable has
    an empty list; rows without a query are left out."""
    asked = results.where(F.col(query).isNotNull())
    good = (F.col("title") != "") & (F.col("url") != "") & (F.col("content") != "") & (F.length("content") <= max_length) & F.col(pos).between(first, first + most - 1)
    at = asked.groupBy(query, pos).agg(F.min(F.when(good, F.struct("result_id", "title", "url", "content"))).alias("_r"))
    lists = at.groupBy(query).agg(F.array_sort(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct(F.col(pos).alias("p"), "_r.title", "_r.url", "_r.content")))).alias("_l"))
    return lists.select(query, F.size("_l").cast("bigint").alias("n_results"), F.transform("_l", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["content"].alias("content"))).alias("results"))


def through_cache(requests: DataFrame, lists: DataFrame, query: str = "search_query", at: str = "made_at") -> DataFrame:
    """``query, query_key, sent, n_results, results``: each distinct query with the results it gets through a cache by normalised
    query: the one put first (then the least) is sent, the others get its list, also if that is empty. ``lists``: as of
    ``grouped``. An aggregate by key joined back, so a popular key is no hot group."""
    put = requests.where(F.col(query).isNotNull()).groupBy(query).agg(F.min(at).alias("_at")).withColumn("query_key", normalise_query(F.col(query)))
    sent = put.groupBy("query_key").agg(F.min(F.struct(F.coalesce("_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("t"), F.col(query).alias("q"))).alias("_s"))
    j = put.join(sent.select("query_key", F.col("_s.q").alias("_sent")), "query_key").join(lists.withColumnRenamed(query, "_sent"), "_sent", "left")
    return j.select(query, "query_key", (F.col(query) == F.col("_sent")).alias("sent"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"), "results")
