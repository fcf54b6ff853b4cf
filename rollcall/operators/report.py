"""Rows of the face sheet, the introduction roster and the job summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.scalars import short_timecode

# Fixed values of the report texts.
NO_NAME = "Name not detected"
TRUNCATE_OVER, TRUNCATE_TO = 34, 31


def speaker_per_face(mappings: DataFrame) -> DataFrame:
    """The speaker of each face; the last mapping of a shared face wins."""
    last = F.max_by(F.struct("speaker_id", "confidence", "evidence_segments"), "mapping_order")
    return mappings.groupBy("job_id", "face_id").agg(last.alias("_m")).select("job_id", "face_id", "_m.*")


def face_sheet(clusters: DataFrame, mappings: DataFrame, labels: DataFrame) -> DataFrame:
    """R2: one row per face with its name and speaker. Order by face_id (as text) when writing."""
    face = clusters.withColumnRenamed("cluster_id", "face_id")
    file_name = F.regexp_extract(F.coalesce("thumbnail_path", F.lit("")), "([^/]*)$", 1)
    return (
        face.join(speaker_per_face(mappings), ["job_id", "face_id"], "left")
        .join(labels.select("job_id", "face_id", "name"), ["job_id", "face_id"], "left")
        .select(
            "job_id", "face_id",
            F.coalesce(F.nullif("name", F.lit("")), F.lit(NO_NAME)).alias("name"),
            F.coalesce("speaker_id", F.lit("")).alias("speaker_id"),
            F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("match_confidence"),
            F.coalesce("evidence_segments", F.lit(0)).cast("long").alias("evidence_segments"),
            F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"),
            F.when(file_name != "", F.concat(F.lit("face_thumbnails/"), file_name)).otherwise("").alias("thumbnail_file"),
        )
    )


def detection_rows(detections: DataFrame) -> DataFrame:
    """Every key filled in, time and confidence to one decimal."""

    def column(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in detections.columns else F.lit(default)

    texts = [
        "face_id", "name", "name_heard", "thumbnail_file", "transcript", "clip_label", "location",
        "name_spelling", "spelling_note", "pronunciation", "intro_clip_file", "source_video",
    ]
    order = ["ord"] if "ord" in detections.columns else []
    return detections.select(
        "job_id", *order, *[column(name, "").alias(name) for name in texts],
        F.round(column("timestamp", 0.0), 1).alias("timestamp"),
        F.round(column("confidence", 0.0), 1).alias("match_confidence"),
        F.lit("").alias("speaker_id"),
        F.lit(0).cast("long").alias("evidence_segments"), F.lit(0).cast("long").alias("sample_count"),
        column("intro_clip_faces_visible", 0).cast("long").alias("intro_clip_faces_visible"),
        column("intro_clip_includes_full_cast", False).alias("intro_clip_includes_full_cast"),
    )


def intro_roster(detections: DataFrame) -> DataFrame:
    """Detection rows with a short timecode. Order by timestamp, then ord, when writing."""
    return detection_rows(detections).withColumn("timecode", short_timecode(F.col("timestamp")))


def detail_lines(rows: DataFrame) -> DataFrame:
    """Up to five text lines per introduction; empty details give no line."""

    def line(prefix: str, name: str, extra: Column | None = None) -> Column:
        shown = F.col(name) != ""
        return F.when(shown if extra is None else shown & extra, F.concat(F.lit(prefix), F.col(name)))

    lines = F.array(
        line("From: ", "location"), line("Pronunciation: ", "pronunciation"), line("Spelling: ", "name_spelling"),
        line("Heard as: ", "name_heard", F.col("name_heard") != F.col("name")), line("", "spelling_note"),
    )
    return rows.withColumn("detail_lines", F.array_compact(lines))


def truncated(text: Column) -> Column:
    """Long text cut for a picture caption."""
    return F.when(F.length(text) > TRUNCATE_OVER, F.concat(F.left(text, F.lit(TRUNCATE_TO)), F.lit("..."))).otherwise(text)


def estimated_people(clusters: DataFrame) -> DataFrame:
    """Number of faces in the cluster summary."""
    return clusters.groupBy("job_id").agg(F.count(F.lit(1)).alias("estimated_people"))


def job_summary(clips: DataFrame, clusters: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts per job of clusters, speaker segments, extra clips and clips."""
    per_clip = clips.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("clip_count"),
        F.count(F.when(~F.col("is_main"), 1)).alias("extra_video_count"),
    )
    faces = clusters.groupBy("job_id").agg(F.count(F.lit(1)).alias("face_cluster_count"))
    spoken = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("speaker_segment_count"))
    return per_clip.join(faces, "job_id", "left").join(spoken, "job_id", "left").fillna(
        0, ["face_cluster_count", "speaker_segment_count"]
    )


def card_lines(sheet: DataFrame) -> DataFrame:
    """The text lines under a face sheet picture."""
    return sheet.withColumn("card_lines", F.array(
        F.concat(F.lit("Face ID: "), "face_id"),
        F.concat(F.lit("Speaker: "), F.coalesce(F.nullif("speaker_id", F.lit("")), F.lit("—"))),
        F.concat(F.lit("Match confidence: "), F.col("match_confidence").cast("string")),
        F.concat(F.lit("Samples seen: "), F.col("sample_count").cast("string")),
    ))


def labels_in_force(stored: DataFrame, given: DataFrame | None) -> DataFrame:
    """Labels handed in replace the stored ones as a whole for the jobs they cover."""
    if given is None:
        return stored
    return stored.join(given.select("job_id").distinct(), "job_id", "left_anti").unionByName(given)
