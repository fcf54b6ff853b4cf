"""The best frame of a job and the faces labelled on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.joins import join_facts
from rollcall.operators.vectors import nearest_cluster

NEAR_S = 0.6
CLUSTER_POINTS = 10


def best_frames(observations: DataFrame) -> DataFrame:
    """The time with most distinct faces, then most observations; the one seen first wins a tie.

    Jobs without any clustered observation get time 0.
    """
    clustered = F.col("cluster_id") != ""
    per_face = observations.groupBy("job_id", "timestamp", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first_obs")
    )
    per_time = per_face.groupBy("job_id", "timestamp").agg(
        F.coalesce(F.sum(F.when(clustered, CLUSTER_POINTS + F.col("n"))), F.lit(0)).alias("score"),
        F.min(F.when(clustered, F.col("first_obs"))).alias("first_obs"),
    )
    best = F.max_by("timestamp", F.struct("score", -F.col("first_obs")))
    return per_time.groupBy("job_id").agg(best.alias("timestamp"), F.max("score").alias("score")).select(
        "job_id", F.when(F.col("score") > 0, F.col("timestamp")).otherwise(F.lit(0.0)).alias("timestamp"), "score"
    )


def observations_near(observations: DataFrame, chosen: DataFrame, tolerance_s: float = NEAR_S) -> DataFrame:
    """Per face the observation closest to the job's chosen time (``chosen_ts``); the first wins a tie."""
    faces = observations.filter(F.col("cluster_id") != "").select(
        "job_id", "obs_id", "timestamp", "bbox", "cluster_id"
    )
    near = join_facts(faces, chosen.select("job_id", "chosen_ts"), ["job_id"], spread=["obs_id"])
    gap = F.abs(F.col("timestamp") - F.col("chosen_ts"))
    picked = F.min_by(F.struct("obs_id", "timestamp", "bbox"), F.struct(gap, F.col("obs_id")))
    return (
        near.filter(gap <= tolerance_s)
        .groupBy("job_id", "chosen_ts", "cluster_id")
        .agg(picked.alias("o"))
        .select("job_id", "chosen_ts", "cluster_id", "o.obs_id", "o.timestamp", "o.bbox")
    )


def frame_faces(
    observations: DataFrame, chosen: DataFrame, centroids: DataFrame, tolerance_s: float = NEAR_S
) -> DataFrame:
    """Faces near the chosen time; jobs with none take every face of that frame, matched by cosine."""
    near = observations_near(observations, chosen, tolerance_s)
    missing = chosen.join(near.select("job_id").distinct(), "job_id", "left_anti")
    around = join_facts(
        observations.select("job_id", "obs_id", "timestamp", "bbox", "embedding"),
        missing.select("job_id", "chosen_ts"), ["job_id"], spread=["obs_id"],
    )
    gap = F.abs(F.col("timestamp") - F.col("chosen_ts"))
    frame = around.filter(gap <= tolerance_s).groupBy("job_id").agg(
        F.min_by("timestamp", F.struct(gap, F.col("timestamp"))).alias("_frame_ts")
    )
    on_frame = join_facts(around, frame, ["job_id"], spread=["obs_id"]).filter(
        F.col("timestamp") == F.col("_frame_ts")
    ).drop("_frame_ts")
    matched = nearest_cluster(on_frame, centroids, metric="cosine").select(*near.columns)
    return near.unionByName(matched)


def captions(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """The face's label, else its cluster id, else "Unknown"."""
    given = labels.select("job_id", F.col("face_id").alias("cluster_id"), F.col("name").alias("_label"))
    return join_facts(faces, given, ["job_id", "cluster_id"], spread=["obs_id"], how="left").withColumn(
        "caption", F.coalesce("_label", F.nullif("cluster_id", F.lit("")), F.lit("Unknown"))
    ).drop("_label")
