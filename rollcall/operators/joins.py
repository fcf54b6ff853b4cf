"""Equi-join shapes for the joins Spark has no operator for: per-key facts, intervals, nearest time.

Every join here carries an equality key, so Catalyst never falls back to a nested loop, and every
hot key is cut into salts on the large side while the small side is repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.session import cut_lineage, salt_count


def _salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def join_facts(
    rows: DataFrame, facts: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join many rows to few facts per key. ``spread`` names row columns that vary inside a hot key."""
    n = salt_count(rows)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n)))
    right = facts.withColumn("_salt", _salts(n))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    point: str,
    start: str,
    end: str,
    slot_s: float,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Pairs (interval, point) with ``start <= point <= end``, both ends included.

    A point falls in one time slot; an interval is listed once per slot it touches. So a pair meets
    in exactly one slot and no pair is lost or repeated. Choose ``slot_s`` near the interval length.
    """
    width = F.lit(float(slot_s))
    n = salt_count(points) if spread else 1
    left = points.withColumn("_slot", F.floor(F.col(point) / width))
    right = intervals.filter(F.col(end) >= F.col(start)).withColumn(
        "_slot", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    )
    keys = [*on, "_slot"]
    if n > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n)))
        right = right.withColumn("_salt", _salts(n))
        keys.append("_salt")
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    return left.join(right, keys).filter(inside).drop("_slot", "_salt")


def around(probes: DataFrame, targets: DataFrame, on: Sequence[str], probe_time: str, target_time: str) -> DataFrame:
    """Probes with ``before`` and ``after``: the last target time up to their own and the first one from it on.

    Probes and targets are merged: dealt into ranges of key and time, each range passed once in order. What lies beyond a
    range's borders comes from a table with one row per range, so a hot key spreads over many ranges and no pair is made.
    A target at the probe's own time is both; probes without a key or time are left out.
    """
    rest = [c for c in probes.columns if c not in on and c != probe_time]
    told = probes.select(*on, F.col(probe_time).cast("double").alias("_at"), F.struct(F.lit(1).alias("_kind"), *rest).alias("_probe"))
    times = targets.select(*on, F.col(target_time).cast("double").alias("_at"), F.lit(None).cast(told.schema["_probe"].dataType).alias("_probe"))
    known = F.col("_at").isNotNull()
    for key in on:
        known = known & F.col(key).isNotNull()
    ranged = told.unionByName(times).filter(known).repartitionByRange(*on, "_at").withColumn("_range", F.spark_partition_id())
    rows = cut_lineage(ranged)
    time = F.when(F.col("_probe").isNull(), F.col("_at"))
    within, ranges = W.partitionBy(*on, "_range"), W.partitionBy(*on)
    probe_last = F.col("_probe").isNotNull()
    ends = rows.groupBy(*on, "_range").agg(F.min(time).alias("_first"), F.max(time).alias("_last")).select(
        *on, "_range", F.max("_last").over(ranges.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_first").over(ranges.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"),
    )
    passed = rows.withColumns({
        "_before": F.last(time, ignorenulls=True).over(within.orderBy("_at", probe_last).rowsBetween(W.unboundedPreceding, 0)),
        "_after": F.last(time, ignorenulls=True).over(within.orderBy(F.desc("_at"), probe_last).rowsBetween(W.unboundedPreceding, 0)),
    }).filter(F.col("_probe").isNotNull())
    before = F.coalesce("_before", "_earlier")
    return passed.join(ends, [*on, "_range"]).select(
        *on, F.col("_at").alias(probe_time), *[F.col("_probe")[c].alias(c) for c in rest],
        before.alias("before"), F.when(before == F.col("_at"), before).otherwise(F.coalesce("_after", "_later")).alias("after"),
    )


def nearest_time(
    probes: DataFrame,
    targets: DataFrame,
    on: Sequence[str],
    probe_id: Sequence[str],
    probe_time: str,
    target_time: str,
    tolerance_s: float,
    matched: str,
) -> DataFrame:
    """Probe ids with the closest target time within the tolerance (earlier time on ties).

    Target times are listed in each time slot from which they can be reached, a sorted array per key and slot, so a probe meets
    one row and is not sorted. An array holds the distinct times of about two tolerances, for frames a few.
    """
    width = max(2.0 * tolerance_s, 1.0)
    reach = tolerance_s + 0.01 * width  # a little more than the tolerance: rounding must not part a pair
    names = list(dict.fromkeys([*on, *probe_id]))
    time = F.col("_time")
    slots = F.sequence(F.floor((time - reach) / width), F.floor((time + reach) / width))
    near = targets.select(*on, F.col(target_time).cast("double").alias("_time")).filter(time.isNotNull()).distinct().withColumn(
        "_slot", F.explode(slots)
    ).groupBy(*on, "_slot").agg(F.sort_array(F.collect_list("_time")).alias("_times"))
    at = F.col("_at")
    told = probes.select(*names, F.col(probe_time).cast("double").alias("_at")).withColumn("_slot", F.floor(at / width))
    reached = F.filter("_times", lambda t: (t >= at - tolerance_s) & (t <= at + tolerance_s))
    best = F.array_min(F.transform(reached, lambda t: F.struct(F.abs(t - at).alias("gap"), t.alias("time"))))
    return told.join(near, [*on, "_slot"]).select(*names, best["time"].alias(matched)).filter(F.col(matched).isNotNull())
