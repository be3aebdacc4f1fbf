"""Cues that arrive as files: each record once, appended to a table, with late rows kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUE_SCHEMA = (
    "cue_id bigint, media_id string, seg_idx int, segment_name string, attempt int, pos int, start_tc string, end_tc string, original string, english string, made_at timestamp_ntz, loaded_at timestamp_ntz"
)


def deliver_once(spark: SparkSession, source: str, place: str, key: str = "cue_id", delay: str = "400 days") -> DataFrame:
    """Reads all files under ``source`` that haven't been read yet as a stream and appends each key's first row to the table in
    ``place``, which is returned. Where the query stands and which keys it knows lie in ``place`` too: called again with the same
    place, after a failure or with more files, it goes on where it stopped and delivers only new rows.

    The state is bounded: keys are forgotten ``delay`` behind the newest ``loaded_at``. Within that time files may come in any
    order; a row that is later still is dropped as too late. Rows without ``loaded_at`` or key are left out.
    """
    stream = spark.readStream.schema(CUE_SCHEMA).parquet(source).where(F.col("loaded_at").isNotNull() & F.col(key).isNotNull())
    once = stream.withColumn("_at", F.col("loaded_at").cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")
    query = once.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/table")
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{place}/table")
