"""Queries of this subpackage over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import timecode_ms
from ..plans.timeline import ms_sql, strip_sql
from ..session import materialise, table
from .bilingual import aligned_lines
from .leakage import leaked_items
from .runs import collapse_runs
from .spans import shared_spans
from .template import residue
from .truncation import truncated
from .tokenizer import encode_corpus


LYRICS = ["reference_lyrics_og", "reference_lyrics_en"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_lines(table(spark, sf_dir, "scene"), "scene_id", *LYRICS, glossary=table(spark, sf_dir, "glossary")).withColumnRenamed("record_id", "scene_id")


def p3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field that isn't, or not only, content, with what was found in it."""
    return residue(table(spark, sf_dir, "scene"), "scene_id", LYRICS, spread=["song_title", "lyrics_site"]).select(F.col("record_id").alias("scene_id"), "field_name", F.array_join("verdict", ",").alias("verdicts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_verdicts(spark, sf_dir).select("scene_id", "field_name")


def _cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene, found = table(spark, sf_dir, "scene"), materialise(p3_found(spark, sf_dir), "residue")
    lyrics = scene.select("scene_id", "lyrics_site", *LYRICS).unpivot(["scene_id", "lyrics_site"], LYRICS, "field_name", "text")
    lyrics = lyrics.join(found, ["scene_id", "field_name"], "left_anti")
    lyrics = lyrics.select(F.lit("scene").alias("table_name"), F.col("scene_id").alias("record_id"), "field_name", F.col("lyrics_site").alias("source"), "text")
    results = table(spark, sf_dir, "search_result").select(F.lit("search_result").alias("table_name"), F.col("result_id").alias("record_id"), F.lit("content").alias("field_name"), F.col("site").alias("source"), F.col("content").alias("text"))
    return lyrics.unionByName(results)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(_cut_values(spark, sf_dir)).select("table_name", "record_id", "field_name").distinct()


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: its values that aren't null or empty, how many of them are cut, and their share."""
    every = _cut_values(spark, sf_dir)
    values = every.where("text <> ''").select("table_name", "record_id", "field_name", "source").distinct()
    total = values.groupBy("table_name", "source").agg(F.count("*").alias("n_values"))
    cut = truncated(every).select("table_name", "record_id", "field_name", "source").distinct().groupBy("table_name", F.col("source").alias("cut_source")).agg(F.count("*").alias("n_cut"))
    j = total.join(cut, (total.table_name == cut.table_name) & total.source.eqNullSafe(cut.cut_source), "left").drop(cut.table_name)
    return j.select("table_name", "source", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_values")).alias("cut_share"))


def _cue_runs(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "cue"), "segment_name", "attempt", "pos", "original", "start_tc", "end_tc", "cue_id", read_time=timecode_ms, exact=exact)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cue_runs(spark, sf_dir).where("n >= 2").select(F.col("entity").alias("segment_name"), "first_pos", "last_pos")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as one cue, single ones included, with the number of its cues and the time it spans."""
    return _cue_runs(spark, sf_dir).select(
        F.col("entity").alias("segment_name"), "first_pos", "last_pos", F.col("n").alias("n_cues"), "from_ms", "to_ms", F.greatest(F.col("to_ms") - F.col("from_ms"), F.lit(0)).alias("span_ms")
    )


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cues alike letter by letter, single ones included, with the number of their cues and the time they span."""
    return _cue_runs(spark, sf_dir, exact=True).select(F.col("entity").alias("segment_name"), "first_pos", "last_pos", F.col("n").alias("n_cues"), "from_ms", "to_ms")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation item that leaked: into how many documents."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), span=80)


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with shared ranges: their number, their characters, and the part of the text they make up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars")).distinct()
    spans = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_ranges"), F.sum(F.col("to_char") - F.col("from_char")).alias("shared_chars"))
    return spans.join(docs, "doc_id").select("doc_id", "n_ranges", "shared_chars", (F.col("shared_chars") / F.col("chars")).alias("shared_part"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_verdicts": p3_verdicts, "p4_found": p4_found, "p4_sources": p4_sources, "p5_found": p5_found, "p5_runs": p5_runs, "p5_exact": p5_exact, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_share": p8_share}

#: Every window of 80 characters compared with every other: right on any table, but slow on large ones.
_SPANS = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 80 AND doc_id IS NOT NULL),
p AS (SELECT doc_id, text, unnest(range(length(text) - 79)) AS i FROM d),
w AS (SELECT doc_id, i, substring(text, i::INT + 1, 80) AS s FROM p),
k AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS l FROM w WHERE s IN (SELECT s FROM k)),
g AS (SELECT doc_id, i, sum(CASE WHEN l IS NULL OR i > l + 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h),
r AS (SELECT doc_id, min(i) AS from_char, max(i) + 80 AS to_char FROM g GROUP BY doc_id, n)"""
_RUNS = f"""WITH c AS (SELECT DISTINCT segment_name, attempt, pos, cue_id, original, start_tc, end_tc FROM cue WHERE segment_name IS NOT NULL AND attempt IS NOT NULL AND pos IS NOT NULL),
top AS (SELECT segment_name, max(attempt) AS attempt FROM c GROUP BY segment_name),
t AS (SELECT segment_name, pos, cue_id, CASE WHEN {strip_sql("original")} <> '' THEN original END AS x, {ms_sql("start_tc")} AS s, {ms_sql("end_tc")} AS e FROM c JOIN top USING (segment_name, attempt)),
b AS (SELECT *, lag(x) OVER (PARTITION BY segment_name ORDER BY pos, cue_id::VARCHAR) AS before FROM t),
g AS (SELECT *, sum(CASE WHEN x = before THEN 0 ELSE 1 END) OVER (PARTITION BY segment_name ORDER BY pos, cue_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS n FROM b)"""
SQL = {
    "p5_exact": f"{_RUNS} SELECT segment_name, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_cues, min(s) AS from_ms, max(e) AS to_ms FROM g WHERE x IS NOT NULL GROUP BY segment_name, n",
    "p8_found": f"{_SPANS} SELECT doc_id, from_char, to_char FROM r",
    "p8_share": f"{_SPANS} SELECT doc_id, count(*) AS n_ranges, sum(to_char - from_char)::BIGINT AS shared_chars, sum(to_char - from_char) / any_value(length(text))::DOUBLE AS shared_part FROM r JOIN d USING (doc_id) GROUP BY doc_id",
}
