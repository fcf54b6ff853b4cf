"""Whole runs over many jobs: analyse, finalise, rebuild. DataFrames in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators import assign, clips, clustering, correlate, names, report, sampling, screengrab, vectors, voices
from rollcall.operators.joins import join_facts
from rollcall.operators.ordered import number_sorted
from rollcall.session import cut_lineage
from rollcall.sources import sinks


@dataclass
class Footage:
    """Input tables of an analysis, see ``rollcall.schemas``. ``observations`` may replace ``landmarks``."""

    clips: DataFrame
    frames: DataFrame
    voice_windows: DataFrame
    transcript_segments: DataFrame
    landmarks: DataFrame | None = None
    observations: DataFrame | None = None


@dataclass
class Results:
    """Tables of a finished run."""

    observations: DataFrame
    face_clusters: DataFrame
    noise: DataFrame
    speaker_segments: DataFrame
    mappings: DataFrame
    lower_thirds: DataFrame
    detections: DataFrame
    labels: DataFrame
    face_sheet: DataFrame
    intro_roster: DataFrame
    summary: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def number_observations(faces: DataFrame, clip_table: DataFrame) -> DataFrame:
    """obs_id in list order: clip, pass, time, face; without gaps from 0 per job."""
    order = clip_table.select("job_id", "source_video", "clip_idx")
    placed = join_facts(faces, order, ["job_id", "source_video"], spread=["timestamp", "face_idx"])
    numbered = number_sorted(placed, ["job_id"], ["clip_idx", "pass", "timestamp", "face_idx"], "obs_id")
    return numbered.drop("clip_idx", "pass", "face_idx")


def speak(windows: DataFrame, people: DataFrame, max_speakers: int) -> DataFrame:
    """Speaker segments from voice windows: V2, V3, V4, V5."""
    counts = voices.speaker_counts(windows, people, max_speakers)
    labels = cut_lineage(clustering.k_cluster_voices(windows, counts))
    timed = windows.select("job_id", "win_idx", "timestamp").join(labels, ["job_id", "win_idx"])
    return voices.segments_from_labels(cut_lineage(voices.smooth_labels(timed)))


def name_faces(
    observations: DataFrame, frames: DataFrame, segments: DataFrame, clip_table: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Detections and labels: T1 to T8, then A1 to A10."""
    order = clip_table.select("job_id", "source_video", "clip_idx", "duration_s")
    placed = names.clean_segments(join_facts(segments, order, ["job_id", "source_video"], spread=["seg_idx"]), "duration_s")
    kept = names.keep_best_repeats(cut_lineage(names.name_events(placed)))
    events = cut_lineage(number_sorted(kept, ["job_id"], ["event_ord"], "event_id").withColumn(
        "event_ord", F.struct("timestamp", (-F.col("confidence")).alias("low"), "event_id")
    ))
    matched = vectors.nearest_cluster(observations, vectors.centroids(observations))
    faces = cut_lineage(assign.faces_on_frames(matched))
    ranked = assign.rank_faces(events, frames, faces)
    captures = assign.probe_captures(events, frames, faces)
    assigned = assign.assign_faces(events, ranked, captures)
    known = observations.filter(F.col("cluster_id") != "").select("job_id").distinct()
    records = assign.detection_records(events.join(known, "job_id", "left_semi"), assigned)
    ordered = number_sorted(records, ["job_id"], ["event_ord"], "ord")
    return ordered, assign.face_labels(events, assigned)


def plan_clips(detections: DataFrame, observations: DataFrame, frames: DataFrame, clip_table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Detections with their intro clip columns."""
    counts = report.estimated_people(clusters).withColumnRenamed("estimated_people", "clusters")
    planned = clips.plan_intro_clips(detections, observations, clips.second_timeline(frames), clip_table, counts)
    added = ["intro_clip_file", "intro_clip_start", "intro_clip_duration", "intro_clip_faces_visible",
             "intro_clip_includes_full_cast", "intro_clip_audio_realigned"]
    return detections.join(planned.select("job_id", "event_id", *added), ["job_id", "event_id"], "left")


def _finish(
    observations: DataFrame, segments: DataFrame, frames: DataFrame, transcripts: DataFrame, clip_table: DataFrame
) -> Results:
    clusters = cut_lineage(clustering.cluster_summary(observations))
    mappings = cut_lineage(correlate.correlate(observations, segments))
    thirds = correlate.lower_thirds(segments, mappings)
    detections, labels = name_faces(observations, frames, transcripts, clip_table)
    detections = cut_lineage(plan_clips(cut_lineage(detections), observations, frames, clip_table, clusters))
    labels = cut_lineage(labels)
    return Results(
        observations=observations, face_clusters=clusters, noise=clustering.noise_counts(observations),
        speaker_segments=segments, mappings=mappings, lower_thirds=thirds, detections=detections, labels=labels,
        face_sheet=report.face_sheet(clusters, mappings, labels), intro_roster=report.intro_roster(detections),
        summary=report.job_summary(clip_table, clusters, segments),
    )


def analyse(footage: Footage, max_speakers: int = 6, count_mode: str = "timestamp") -> Results:
    """Everything from face rows, voice windows and transcripts to reports, for all jobs at once."""
    observations = footage.observations
    if observations is None:
        observations = number_observations(sampling.observations_from_landmarks(footage.landmarks), footage.clips)
    observations = cut_lineage(clustering.cluster_faces(cut_lineage(observations), sampling.frame_sizes(footage.clips), count_mode))
    people = cut_lineage(report.estimated_people(clustering.cluster_summary(observations)))
    segments = cut_lineage(speak(footage.voice_windows, people, max_speakers))
    return _finish(observations, segments, footage.frames, footage.transcript_segments, footage.clips)


def rebuild(
    observations: DataFrame, segments: DataFrame, frames: DataFrame, transcripts: DataFrame, clip_table: DataFrame,
    count_mode: str = "timestamp",
) -> Results:
    """Re-cluster stored observations and redo everything after it; speaker segments stay."""
    clustered = cut_lineage(clustering.cluster_faces(observations, sampling.frame_sizes(clip_table), count_mode))
    return _finish(clustered, segments, frames, transcripts, clip_table)


@dataclass
class Finals:
    """Rows of the final reports."""

    lower_third_json: DataFrame
    lower_third_csv: DataFrame
    edl: DataFrame
    screengrab: DataFrame
    face_sheet: DataFrame
    intro_roster: DataFrame


def finalise(
    lower_thirds: DataFrame, mappings: DataFrame, observations: DataFrame, clusters: DataFrame, labels: DataFrame,
    detections: DataFrame, at: DataFrame | None = None,
) -> Finals:
    """Reports with the confirmed labels. ``at`` (job_id, chosen_ts) overrides the best frame of a job."""
    labelled = correlate.apply_labels(lower_thirds, labels)
    chosen = screengrab.best_frames(observations).select("job_id", F.col("timestamp").alias("chosen_ts"))
    if at is not None:
        chosen = chosen.join(at, "job_id", "left_anti").unionByName(at)
    faces = screengrab.frame_faces(observations, chosen, vectors.centroids(observations))
    return Finals(
        lower_third_json=sinks.lower_third_json_rows(labelled),
        lower_third_csv=sinks.lower_third_csv_rows(labelled),
        edl=sinks.edl_lines(labelled),
        screengrab=sinks.screengrab_labels(faces, labels),
        face_sheet=report.face_sheet(clusters, mappings, labels),
        intro_roster=report.intro_roster(detections),
    )


def write_finals(finals: Finals, folder: str) -> None:
    """All report files of all jobs (K1 to K3, K6, K7, K9)."""
    sinks.write_table(finals.lower_third_json, ["seg_idx"], f"{folder}/lower_thirds_json", "json")
    sinks.write_table(finals.lower_third_csv, ["seg_idx"], f"{folder}/lower_thirds_csv", "csv")
    sinks.write_lines(finals.edl, ["event_no", "part"], f"{folder}/lower_third_markers")
    sinks.write_table(finals.screengrab, ["face_id"], f"{folder}/named_screengrab", "json")
    sheet, roster = sinks.face_sheet_rows(finals.face_sheet), finals.intro_roster
    sinks.write_table(sheet, ["face_id"], f"{folder}/face_name_sheet_json", "json")
    sinks.write_table(sheet, ["face_id"], f"{folder}/face_name_sheet_csv", "csv")
    order = ["timestamp", "ord"] if "ord" in roster.columns else ["timestamp"]
    sinks.write_table(roster, order, f"{folder}/intro_roster_json", "json")
    sinks.write_table(sinks.intro_roster_rows(roster), order, f"{folder}/intro_roster_csv", "csv")
