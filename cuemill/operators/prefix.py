"""Sums of what lies before a row, without a window over a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, parallelism

#: Rows of one key that a window holds: the width of a block of the order column.
BLOCK = 4096


def sums_before(df: DataFrame, key: str, order: str, values: dict[str, str]) -> DataFrame:
    """Adds for each ``new: column`` of ``values`` the sum of the column over the key's rows with a smaller ``order``, an integer
    that numbers the key's rows (ties count as not before). Sums go over blocks of ``BLOCK`` numbers first and within a
    block then, so that a key with very many rows is spread over as many windows. Nulls count as 0; a null key is one key."""
    # the row is packed, so that none of its columns can clash with those added here
    sums = [f"v{i}" for i in range(len(values))]
    given = [F.coalesce(F.col(c), F.lit(0)).alias(v) for v, c in zip(sums, values.values())]
    b = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("key"), F.col(order).alias("at"), F.floor(F.col(order) / BLOCK).alias("block"), *given)
    over = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = b.groupBy("key", "block").agg(*[F.sum(v).alias(v) for v in sums])
    blocks = blocks.select(F.col("key").alias("b_key"), F.col("block").alias("b_block"), *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"b_{v}") for v in sums])
    within = Window.partitionBy("key", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({f"w_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in sums})
    j = b.join(blocks, F.col("key").eqNullSafe(F.col("b_key")) & F.col("block").eqNullSafe(F.col("b_block")))
    return j.select("row.*", *[(F.col(f"w_{v}") + F.col(f"b_{v}")).cast("bigint").alias(n) for n, v in zip(values, sums)])


def running_before(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in ascending order of ``order``, nulls first, which must tell
    rows apart. Rows are range-sorted over the cluster and written once; partitions' sums, one row each, are combined and joined back."""
    keys = [f"k{i}" for i in range(len(order))]
    slim = df.select(F.struct(*df.columns).alias("row"), *[c.alias(k) for c, k in zip(map(_plain, order), keys)], F.coalesce(F.col(value), F.lit(0)).alias("v"))
    by = [F.col(k).asc_nulls_first() for k in keys]
    ranged = materialise(slim.repartitionByRange(parallelism(df.sparkSession), *by).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = ranged.groupBy("part").agg(F.sum("v").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    within = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("w", F.coalesce(F.sum("v").over(within), F.lit(0))).join(parts, "part")
    return out.select("row.*", (F.col("w") + F.col("s")).cast("bigint").alias(name))


def _plain(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
