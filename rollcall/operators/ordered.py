"""Ordered operations inside one job without putting the job into one task.

Rows are cut into chunks of a bounded index range. Work that needs neighbours copies the few rows at
chunk edges; work that needs a running total or a following value goes through a table with one row
per chunk. A window therefore never sees more than one chunk, or one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.session import chunk_rows, cut_lineage


def with_halo(df: DataFrame, index: str, halo: int) -> DataFrame:
    """Adds ``_chunk`` and ``_own``; rows within ``halo`` of a chunk edge are copied to the next chunk."""
    size = chunk_rows(df)
    home = F.floor(F.col(index) / F.lit(size))
    reach = F.sequence(
        F.floor((F.col(index) - halo) / F.lit(size)), F.floor((F.col(index) + halo) / F.lit(size))
    )
    return df.withColumn("_chunk", F.explode(reach)).withColumn("_own", F.col("_chunk") == home)


def number_rows(df: DataFrame, keys: Sequence[str], index: str, out: str, first: int = 1) -> DataFrame:
    """Gapless numbers per key in the order of a unique integer column."""
    size = chunk_rows(df)
    cut = df.withColumn("_chunk", F.floor(F.col(index) / F.lit(size)))
    offsets = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk")) - F.col("_n"))
        .drop("_n")
    )
    local = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(index))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_local") + F.col("_before") + F.lit(first - 1))
        .drop("_local", "_before", "_chunk")
    )


def number_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, first: int = 0) -> DataFrame:
    """Gapless numbers per key in the order of any columns.

    Rows are dealt into ranges of key and order and written once, so a hot key spreads over many ranges; a running sum
    over the ranges of a key gives each range its start. Rows that agree in all order columns get numbers in any order.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    cut = cut_lineage(ranged)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))
    ).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(starts, [*keys, "_range"])
        .withColumn(out, (F.col("_local") + F.col("_before") + F.lit(first - 1)).cast("long"))
        .drop("_local", "_before", "_range")
    )


def following(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: str, out: str) -> DataFrame:
    """Value of the next row per key in the order of ``order``; ``chunk`` must be monotone in ``order``."""
    cut = df.withColumn("_chunk", chunk)
    heads = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.min_by(value, order).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(W.partitionBy(*keys).orderBy("_chunk")))
        .drop("_head")
    )
    local = F.lead(value).over(W.partitionBy(*keys, "_chunk").orderBy(order))
    return (
        cut.withColumn("_local", local)
        .join(heads, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_local", "_next_head"))
        .drop("_local", "_next_head", "_chunk")
    )
