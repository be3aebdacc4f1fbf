"""Continuous periods and gaps of intervals that overlap, nest or leave silence.

Method: rows are range-sorted over the whole cluster by entity, then version (highest first) and start. One scan of
each partition merges what it sees into local islands and a summary of the entity it ends in (its version,
the latest end and the start of its open island). The summaries, one per partition, are combined from left to right;
a rescan of the islands with the carried state extends, drops or relabels those that an earlier partition
reaches into. An entity may therefore span any number of partitions: no task ever holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, parallelism

ISLAND_SCHEMA = "part int, kind int, entity string, version int, from_ms bigint, to_ms bigint, n bigint, prev_ms bigint"
#: kind of a row in the scan's output
ISLAND, SUMMARY = 0, 1


def _scan(batches):
    """Islands of one sorted partition. State between Arrow batches: the entity, its version, latest end and open island."""
    part = TaskContext.get().partitionId()
    entity = version = last = None
    end = open_from = count = prev = None  # of the open island; prev is the end before it, null where unknown
    first = True  # the entity is the partition's first, so what lies before it is unknown

    def rows(out):
        cols = list(zip(*out)) if out else [[]] * 8
        types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in ISLAND_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for b in batches:
        if not b.num_rows:
            continue
        out = []
        ids = b.column("entity").dictionary_encode()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        names, code = ids.dictionary.to_pylist(), ids.indices.to_numpy(zero_copy_only=False)
        ver = b.column("version").to_numpy(zero_copy_only=False)
        usable = pc.is_valid(b.column("start_ms")).to_numpy(zero_copy_only=False)
        start = pc.fill_null(b.column("start_ms"), 0).to_numpy(zero_copy_only=False)
        stop = pc.fill_null(b.column("end_ms"), 0).to_numpy(zero_copy_only=False)
        key = b.column("row_key").to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(code)]):
            name = names[code[lo]]
            if name != entity:
                if count:
                    out.append((part, ISLAND, entity, version, open_from, end, count, prev))
                first = entity is None
                entity, version, last, count, end, open_from = name, int(ver[lo]), None, 0, None, None
                prev = None if first else 0
            for i in range(lo, hi):  # a few dozen rows an entity; only comparisons
                if ver[i] != version or not usable[i]:
                    continue
                s, e = int(start[i]), int(stop[i])
                same = (s, e, key[i])
                if same == last:  # the same record delivered again lies next to itself
                    continue
                last = same
                if not count:
                    open_from, end, count = s, e, 1
                elif s <= end:
                    end, count = max(end, e), count + 1
                else:
                    out.append((part, ISLAND, entity, version, open_from, end, count, prev))
                    prev, open_from, end, count = end, s, e, 1
        if out:
            yield rows(out)
    if entity is not None:
        out = [(part, ISLAND, entity, version, open_from, end, count, prev)] if count else []
        yield rows([*out, (part, SUMMARY, entity, version, open_from, end, count, None)])


def _carried(summaries: list) -> list[tuple]:
    """Prefix-combine: the state carried into each partition: (part, entity, version, latest end, open island's start)."""
    carried, state = [], None
    for r in summaries:
        if state:
            carried.append((r["part"], *state))
        mine = (r["entity"], r["version"], r["to_ms"], r["from_ms"])
        if not state or state[0] != mine[0]:
            state = mine
        elif state[1] == mine[1]:  # the same entity and version goes on
            if mine[2] is not None:
                end, start = state[2:]
                state = mine if end is None or mine[3] > end else (*mine[:2], max(end, mine[2]), start)
        # else a lower version of the carried entity: it counts for nothing
    return carried


def merge_intervals(df: DataFrame, entity: str, version: str, start: str, end: str, key: str) -> DataFrame:
    """Disjoint islands of each entity's highest version.

    ``df`` has one row per interval; ``start``/``end`` are bigint. Intervals that overlap or touch form one island. A row
    whose start or end is null or with start not before end is ignored, but its version still counts as the entity's
    highest. Rows alike in start, end and ``key`` are one record. Rows with a null entity or version are left out.
    Result: entity, version, from_ms, to_ms, n (records), prev_ms (the end of what lies before, 0 at the head, so
    ``from_ms - prev_ms`` is the gap before the island), written once. Other columns of ``df``, of whatever name, aren't read.
    """
    spark = df.sparkSession
    ok = F.col(start) < F.col(end)
    slim = df.select(
        F.col(entity).cast("string").alias("entity"),
        F.col(version).cast("int").alias("version"),
        F.when(ok, F.col(start)).cast("bigint").alias("start_ms"),
        F.when(ok, F.col(end)).cast("bigint").alias("end_ms"),
        F.col(key).cast("string").alias("row_key"),
    ).where("entity is not null and version is not null")
    order = ["entity", F.desc("version"), "start_ms", "end_ms", "row_key"]
    ranged = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    scan = materialise(ranged.mapInArrow(_scan, ISLAND_SCHEMA), "islands")
    # one row per partition of the sort, so bounded by the number of partitions and not by the data
    summaries = scan.where(f"kind = {SUMMARY}").orderBy("part").collect()
    carried = F.broadcast(spark.createDataFrame(_carried(summaries), "part int, c_entity string, c_version int, c_end bigint, c_from bigint"))
    torn = F.broadcast(carried.select(F.col("c_entity").alias("t_entity")).distinct())
    islands = scan.where(f"kind = {ISLAND}").join(carried, "part", "left").join(torn, F.col("entity") == F.col("t_entity"), "left")
    mine = F.coalesce((F.col("entity") == F.col("c_entity")), F.lit(False))
    reached = mine & F.coalesce(F.col("from_ms") <= F.col("c_end"), F.lit(False))
    known = islands.where(~mine | (F.col("version") == F.col("c_version"))).select(
        "entity",
        "version",
        F.when(reached, F.col("c_from")).otherwise(F.col("from_ms")).alias("from_ms"),
        F.when(mine, F.greatest("c_end", "to_ms")).otherwise(F.col("to_ms")).alias("to_ms"),
        "n",
        F.when(~reached, F.coalesce(F.when(mine, F.greatest("c_end", "prev_ms")).otherwise(F.col("prev_ms")), F.lit(0))).alias("prev_ms"),
        F.col("t_entity").isNotNull().alias("torn"),
    )
    # pieces of one island that lie in several partitions meet here; only torn entities can have any
    met = known.where("torn").groupBy("entity", "version", "from_ms").agg(F.max("to_ms").alias("to_ms"), F.sum("n").alias("n"), F.min("prev_ms").alias("prev_ms"))
    return materialise(known.where("not torn").drop("torn").unionByName(met), "merged")


def periods_and_gaps(islands: DataFrame, spans: DataFrame, min_gap_ms: int = 2000, min_records: int = 2) -> DataFrame:
    """``kind, entity, from_ms, to_ms``: periods of at least ``min_records`` and gaps of at least ``min_gap_ms``.

    ``spans`` has ``entity, duration_ms``, one row per entity. Gaps lie before the first island (from 0), between islands
    and after the last (to the duration); an entity of ``spans`` without islands gives one gap over its whole
    duration, however short. An entity without a known duration has no last gap.
    """
    # of each island the period it is and the gap before it, in one pass
    period = F.when(F.col("n") >= min_records, F.struct(F.lit("period").alias("kind"), F.col("from_ms"), F.col("to_ms")))
    before = F.when(F.col("from_ms") - F.col("prev_ms") >= min_gap_ms, F.struct(F.lit("gap").alias("kind"), F.col("prev_ms").alias("from_ms"), F.col("from_ms").alias("to_ms")))
    found = islands.select("entity", F.explode(F.array_compact(F.array(period, before))).alias("x")).select("x.kind", "entity", "x.from_ms", "x.to_ms")
    last = islands.groupBy("entity").agg(F.max("to_ms").alias("last_ms"))
    tail = (
        spans.join(last, "entity", "left")
        .where((F.col("last_ms").isNull() & (F.col("duration_ms") > 0)) | (F.col("duration_ms") - F.col("last_ms") >= min_gap_ms))
        .select(F.lit("gap").alias("kind"), "entity", F.coalesce("last_ms", F.lit(0)).cast("bigint").alias("from_ms"), F.col("duration_ms").cast("bigint").alias("to_ms"))
    )
    return found.unionByName(tail)
