"""Speaker to face correlation and lower-third rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.joins import interval_join, join_facts

SEGMENT_SLOT_S = 4.0
TIE_DIGITS = 12  # scores closer than this are ties, whatever the order of summation


def segment_observations(observations: DataFrame, segments: DataFrame, main_only: DataFrame | None = None) -> DataFrame:
    """Clustered observations inside each closed speaker segment.

    ``main_only`` is the clip table (job_id, source_video, is_main): only faces of each job's main clip count then.
    """
    faces = observations.filter(F.col("cluster_id") != "")
    if main_only is not None:
        main = main_only.filter("is_main").select("job_id", "source_video")
        faces = faces.join(main, ["job_id", "source_video"], "left_semi")
    faces = faces.select("job_id", "obs_id", "timestamp", "cluster_id", "lip_openness")
    spans = segments.select("job_id", "seg_idx", "speaker_id", "start", "end")
    return interval_join(faces, spans, ["job_id"], "timestamp", "start", "end", SEGMENT_SLOT_S, spread=["obs_id"])


def lip_activity(pairs: DataFrame) -> DataFrame:
    """Mean plus population deviation of lip opening for each segment and face."""
    return pairs.groupBy("job_id", "seg_idx", "speaker_id", "cluster_id").agg(
        (F.stddev_pop("lip_openness") + F.avg("lip_openness")).alias("score"),
        F.min("obs_id").alias("first_obs"),
        F.count(F.lit(1)).alias("samples"),
    )


def best_face(scores: DataFrame) -> DataFrame:
    """The most active face of each segment; the face seen first wins a tie."""
    rank = F.struct(F.round("score", TIE_DIGITS), -F.col("first_obs"))
    return scores.groupBy("job_id", "seg_idx", "speaker_id").agg(F.max_by("cluster_id", rank).alias("face_id"))


def votes(best: DataFrame) -> DataFrame:
    """How many segments of a speaker chose each face."""
    return best.groupBy("job_id", "speaker_id", "face_id").agg(
        F.count(F.lit(1)).alias("votes"), F.min("seg_idx").alias("first_seg")
    )


def speaker_face_mappings(ballots: DataFrame) -> DataFrame:
    """The face with most votes per speaker; the face voted for first wins a tie."""
    winner = F.max_by(F.struct("face_id", "votes"), F.struct("votes", -F.col("first_seg")))
    return (
        ballots.groupBy("job_id", "speaker_id")
        .agg(winner.alias("won"), F.sum("votes").alias("total"), F.min("first_seg").alias("mapping_order"))
        .select(
            "job_id", "speaker_id", F.col("won.face_id").alias("face_id"),
            (F.col("won.votes") / F.col("total")).alias("confidence"),
            F.col("won.votes").alias("evidence_segments"), "mapping_order",
        )
    )


def correlate(observations: DataFrame, segments: DataFrame, main_only: DataFrame | None = None) -> DataFrame:
    """J1 to J5 in one plan."""
    pairs = segment_observations(observations, segments, main_only)
    return speaker_face_mappings(votes(best_face(lip_activity(pairs))))


def lower_thirds(segments: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each segment whose speaker has a face; the name starts out as the face id."""
    facts = mappings.select("job_id", "speaker_id", "face_id", "confidence")
    return join_facts(segments, facts, ["job_id", "speaker_id"], spread=["seg_idx"]).select(
        "job_id", "seg_idx", "start", "end", "speaker_id", "face_id", F.col("face_id").alias("name"), "confidence"
    )


def apply_labels(thirds: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the name by the face's label. An empty label is used as it is."""
    given = labels.select("job_id", "face_id", F.col("name").alias("label"))
    return (
        join_facts(thirds, given, ["job_id", "face_id"], spread=["seg_idx"], how="left")
        .withColumn("name", F.coalesce("label", "face_id"))
        .select(*thirds.columns)
    )


def extra_clips(clips: DataFrame) -> DataFrame:
    """Clips of a job other than its main clip, compared by path."""
    main = clips.filter("is_main").select("job_id", "source_video")
    return clips.join(main, ["job_id", "source_video"], "left_anti")
