"""Reuse of stored files by content, and eviction of the oldest to keep within a capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import hash_key, is_managed
from .prefix import running_before


def reusable(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per local file (``file_name, display_name, size_bytes, sha256_hex``) the first stored one, by name, of equal size and
    hash under the file's own or its unique display name. Failed stored files are passed over; one without a state isn't failed. An equi-join on size and
    hash in one spelling; the first match is an aggregate."""
    kept = remote.where(F.coalesce(F.upper("state") != "FAILED", F.lit(True))).select("remote_name", F.col("display_name").alias("r_name"), F.col("size_bytes").alias("r_size"), hash_key(F.col("sha256_hash")).alias("r_hash"))
    j = local.join(kept, (F.col("size_bytes") == F.col("r_size")) & (F.lower("sha256_hex") == F.col("r_hash")) & ((F.col("r_name") == F.col("file_name")) | (F.col("r_name") == F.col("display_name"))))
    return j.groupBy("file_name", "display_name").agg(F.min("remote_name").alias("remote_name"))


def evict(remote: DataFrame, required_bytes: int, capacity: int | None = None, capacity_share: float | None = None) -> DataFrame:
    """``remote_name, size_bytes``: the managed files to delete, oldest first (expiration, or else creation, undated ones first;
    then name), until total and required bytes fit into the capacity, given in bytes or as a share of the total.

    Sizes are summed up over the range-sorted files, so neither a busy day nor very many undated files meet in one task. The
    total is a row of the plan, not a job of its own.
    """
    total = remote.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_total"))
    cap = F.lit(capacity) if capacity is not None else F.floor(F.col("_total") * F.lit(float(capacity_share))).cast("bigint")
    managed = remote.where(is_managed(F.col("display_name"))).withColumn("_at", F.coalesce("expiration_time", "create_time"))
    m = running_before(managed, ["_at", "remote_name"], "size_bytes", "_deleted")
    m = m.join(F.broadcast(total), F.lit(True))  # one row
    return m.where(F.col("_total") + F.lit(required_bytes) - F.col("_deleted") > cap).select("remote_name", "size_bytes")
