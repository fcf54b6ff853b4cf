"""k clusters per job by k-means on the within-cluster variance, for jobs where a whole Ward tree is not wanted.

All jobs run in one plan. Rounds are a fixed number and chained lazily; each round sends only one sum
and count per block and cluster through the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.blocks import BLOCK, cut_blocks, renewed, squared_distances, stack
from rollcall.operators.vector_sums import mean_of_sums, merged_sums
from rollcall.session import cut_lineage

ROUNDS = 10
#: Seeding rounds after which lineage is cut and jobs that have all their seeds leave.
CUT_ROUNDS = 3


def prepare_points(points: DataFrame) -> DataFrame:
    """Points (job_id, point_id, vector) in blocks, written once for all rounds."""
    return cut_lineage(cut_blocks(points.select("job_id", "point_id", "vector"), ["job_id"]))


def _on_blocks(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    return renewed(facts.join(blocks, "job_id"))


def farthest_first(points: DataFrame, first: DataFrame, k: DataFrame, rounds: int) -> DataFrame:
    """Seeds per job: start from ``first`` (job_id, label, vector) and add the farthest point until k.

    ``rounds`` is the largest number of seeds any job still lacks. A job stops early when no point is
    left that differs from its seeds. Plans stay small however many seeds one job wants: lineage is cut
    every few rounds, and only jobs that still lack seeds go on.
    """
    blocks = points.select(*BLOCK).distinct()
    schema = (
        "job_id string, k long, seeds array<array<double>>, distance double, point_id long, vector array<double>"
    )

    def farthest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["job_id", "k", "seeds", "distance", "point_id", "vector"])
        seeds = right.seeds.iloc[0]
        vectors = stack(left.vector)
        gaps = squared_distances(vectors, stack(pd.Series(list(seeds)))).min(axis=1)
        best = np.lexsort((left.point_id.to_numpy(), -gaps))[0]
        return pd.DataFrame({
            "job_id": [left.job_id.iloc[0]], "k": [right.k.iloc[0]], "seeds": [seeds],
            "distance": [gaps[best]], "point_id": [left.point_id.iloc[best]], "vector": [vectors[best]],
        })

    seeds = first.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("label", "vector"))), lambda s: s["vector"].cast("array<double>")
        ).alias("seeds")
    ).join(k.select("job_id", F.col("k").cast("long").alias("k")), "job_id", "left").withColumn(
        "k", F.coalesce("k", F.lit(1).cast("long"))  # a job without a count keeps its first seed
    )
    finished = []
    for done in range(1, rounds + 1):
        candidates = points.groupBy(*BLOCK).cogroup(_on_blocks(seeds, blocks).groupBy(*BLOCK)).applyInPandas(
            farthest, schema
        )
        far = F.max_by(F.struct("distance", "vector"), F.struct("distance", -F.col("point_id")))
        grown = candidates.groupBy("job_id").agg(
            F.first("seeds").alias("seeds"), F.first("k").alias("k"), far.alias("_far")
        )
        more = (F.size("seeds") < F.col("k")) & (F.col("_far.distance") > 0)
        seeds = grown.select(
            "job_id", "k",
            F.when(more, F.concat("seeds", F.array("_far.vector"))).otherwise(F.col("seeds")).alias("seeds"),
            more.alias("_grew"),
        )
        if done % CUT_ROUNDS == 0 and done < rounds:
            settled = cut_lineage(seeds)
            rest = F.col("_grew") & (F.size("seeds") < F.col("k"))
            finished.append(settled.filter(~rest).select("job_id", "k", "seeds"))
            seeds = settled.filter(rest)
            if seeds.isEmpty():
                break
        seeds = seeds.select("job_id", "k", "seeds")
    for part in finished:
        seeds = seeds.select("job_id", "k", "seeds").unionByName(part)
    return seeds.select("job_id", F.posexplode("seeds").alias("label", "vector"))


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Label of the closest centre per point; the lowest label wins a tie."""

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["job_id", "point_id", "label"])
        right = right.sort_values("label")
        best = squared_distances(stack(left.vector), stack(right.vector)).argmin(axis=1)
        return pd.DataFrame({
            "job_id": left.job_id, "point_id": left.point_id, "label": right.label.to_numpy()[best],
        })

    blocks = points.select(*BLOCK).distinct()
    return points.groupBy(*BLOCK).cogroup(_on_blocks(centers, blocks).groupBy(*BLOCK)).applyInPandas(
        closest, "job_id string, point_id long, label int"
    )


def update(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One round: new centres as means of the closest points; a centre without points stays."""

    def partial_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["job_id", "label", "total", "n", "first"])
        right = right.sort_values("label")
        vectors, old = stack(left.vector), stack(right.vector)
        best = squared_distances(vectors, old).argmin(axis=1)
        total = np.zeros_like(old)
        np.add.at(total, best, vectors)
        counts = np.bincount(best, minlength=len(old))
        return pd.DataFrame({
            "job_id": left.job_id.iloc[0], "label": right.label.to_numpy(),
            "total": list(total), "n": [np.full(old.shape[1], n) for n in counts], "first": 0,
        })

    blocks = points.select(*BLOCK).distinct()
    sums = points.groupBy(*BLOCK).cogroup(_on_blocks(centers, blocks).groupBy(*BLOCK)).applyInPandas(
        partial_sums, "job_id string, label int, total array<double>, n array<long>, first long"
    )
    means = merged_sums(sums, ["job_id", "label"]).select("job_id", "label", mean_of_sums().alias("_mean"), F.get("n", F.lit(0)).alias("_n"))
    known = renewed(centers.join(points.select("job_id").distinct(), "job_id", "left_semi"))
    return known.join(means, ["job_id", "label"], "left").select(
        "job_id", "label", F.when(F.col("_n") > 0, F.col("_mean")).otherwise(F.col("vector").cast("array<double>")).alias("vector")
    )


def _moved(before: DataFrame, after: DataFrame) -> bool:
    """Whether any centre changed; one small join per pair of rounds, nothing but a yes or no comes back."""
    old = renewed(before).withColumnRenamed("vector", "_old")
    return not after.join(old, ["job_id", "label"]).filter(F.col("vector") != F.col("_old")).isEmpty()


def kmeans(points: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Labels (job_id, point_id, label) after ``rounds`` rounds over prepared points, fewer once all jobs rest."""
    centers = cut_lineage(seeds.select("job_id", F.col("label").cast("int").alias("label"), "vector"))
    for done in range(0, rounds, 2):
        previous = centers
        for _ in range(min(2, rounds - done)):
            centers = update(points, centers)
        centers = cut_lineage(centers)
        if not _moved(previous, centers):
            break
    return assign(points, centers)
