"""Output rows and document lines of the reports (K1-K9).

JSON documents are produced as numbered lines: one line per record plus opening and closing lines. A
job's document is the concatenation of its lines, so no job is ever collected into one row or task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.scalars import long_timecode
from rollcall.operators.joins import join_facts
from rollcall.operators.ordered import number_rows

# Fixed values of the marker file.
EDL_HEADER = ("TITLE: Lower Third Markers", "FCM: NON-DROP FRAME")
EDL_EVENT = "%03d  AX       V     C        %s %s %s %s"
EDL_COMMENT = "* COMMENT: speaker=%s face=%s confidence=%.2f"


def lower_third_json_rows(thirds: DataFrame) -> DataFrame:
    """K1: start and end as they are, confidence to three decimals."""
    return thirds.select(
        "job_id", "seg_idx", "start", "end", "name", "speaker_id", "face_id", F.round("confidence", 3).alias("confidence")
    )


def lower_third_csv_rows(thirds: DataFrame) -> DataFrame:
    """K2: eight columns with both timecodes, numbers to three decimals."""
    return thirds.select(
        "job_id", "seg_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"),
        long_timecode(F.col("start")).alias("start_tc"), long_timecode(F.col("end")).alias("end_tc"),
        "name", "speaker_id", "face_id", F.round("confidence", 3).alias("confidence"),
    )


def edl_lines(thirds: DataFrame) -> DataFrame:
    """K3: two header lines per job and three lines per lower third, numbered from 1."""
    numbered = number_rows(thirds, ["job_id"], "seg_idx", "event_no")
    start, end = long_timecode(F.col("start")), long_timecode(F.col("end"))
    lines = F.array(
        F.format_string(EDL_EVENT, F.col("event_no"), start, end, start, end),
        F.concat(F.lit("* FROM CLIP NAME: "), "name"),
        F.format_string(EDL_COMMENT, "speaker_id", "face_id", F.round("confidence", 2)),
    )
    body = numbered.select("job_id", F.col("event_no").cast("long").alias("event_no"), F.posexplode(lines).alias("part", "line"))
    header = thirds.select("job_id").distinct().select(
        "job_id", F.lit(-1).cast("long").alias("event_no"), F.posexplode(F.array(*map(F.lit, EDL_HEADER))).alias("part", "line")
    )
    return header.unionByName(body)


def write_lines(lines: DataFrame, order: list[str], path: str, mode: str = "overwrite") -> None:
    """Text files under ``job_id=<id>``; within a job part files follow each other in line order."""
    sorted_lines = lines.repartitionByRange("job_id", *order).sortWithinPartitions("job_id", *order)
    sorted_lines.select("job_id", "line").write.mode(mode).partitionBy("job_id").text(path)


def array_document(jobs: DataFrame, sections: dict[str, tuple[DataFrame, Column]], fixed: DataFrame | None = None) -> DataFrame:
    """Lines (job_id, section, ord, line) of ``{"name": [record, ...], ...}`` for every job in ``jobs``.

    ``sections`` maps a name to (rows with job_id and a unique integer ``ord``, record column). ``fixed``
    holds (job_id, line) with plain members that open the document.
    """
    parts = []
    opening = jobs.select("job_id", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("ord"))
    if fixed is None:
        parts.append(opening.withColumn("line", F.lit("{")))
    else:
        members = fixed.select("job_id", F.concat(F.lit("{"), "line", F.lit(",")).alias("line"))
        parts.append(opening.join(members, "job_id"))
    last = len(sections) - 1
    for number, (name, (rows, record)) in enumerate(sections.items()):
        def edge(position: int, text: str, number=number) -> DataFrame:
            at = -(2**62) if position < 0 else 2**62
            return jobs.select("job_id", F.lit(number).alias("section"), F.lit(at).cast("long").alias("ord"), F.lit(text).alias("line"))

        firsts = rows.groupBy("job_id").agg(F.min("ord").alias("_first"))
        body = join_facts(rows.select("job_id", F.col("ord").cast("long").alias("ord"), record.alias("_record")),
                          firsts, ["job_id"], spread=["ord"])
        comma = F.when(F.col("ord") > F.col("_first"), ",").otherwise("")
        parts.append(edge(-1, f'"{name}": ['))
        parts.append(body.select("job_id", F.lit(number).alias("section"), "ord", F.concat(comma, F.to_json("_record")).alias("line")))
        parts.append(edge(1, "]," if number < last else "]"))
    parts.append(jobs.select("job_id", F.lit(len(sections)).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit("}").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def correlation_document(mappings: DataFrame, thirds: DataFrame, jobs: DataFrame) -> DataFrame:
    """K4: mappings and lower thirds of each job."""
    return array_document(jobs, {
        "speaker_face_mappings": (
            mappings.withColumn("ord", F.col("mapping_order")),
            F.struct("speaker_id", "face_id", "confidence", "evidence_segments"),
        ),
        "lower_thirds": (
            thirds.withColumn("ord", F.col("seg_idx")),
            F.struct("start", "end", "speaker_id", "face_id", "name", "confidence"),
        ),
    })


def _box_list(box: str) -> Column:
    return F.array(*[F.col(f"{box}.{side}") for side in ("x1", "y1", "x2", "y2")])


def faces_document(clips: DataFrame, clusters: DataFrame, observations: DataFrame, noise: DataFrame) -> DataFrame:
    """K5: videos, clusters, observations and counts of each job."""
    videos = clips.groupBy("job_id").agg(
        F.max(F.when(F.col("is_main"), F.col("source_video"))).alias("video"),
        F.array_sort(F.collect_list(F.struct("clip_idx", "source_video"))).alias("_clips"),
    )
    people = clusters.groupBy("job_id").agg(F.count(F.lit(1)).alias("people"))
    members = F.to_json(F.struct(
        "video", F.col("_clips.source_video").alias("sampled_videos"),
        F.coalesce("noise_count", F.lit(0)).alias("noise_count"), F.coalesce("people", F.lit(0)).alias("estimated_people"),
    ))
    fixed = videos.join(noise, "job_id", "left").join(people, "job_id", "left").select(
        "job_id", F.expr("1").alias("_one"), members.alias("_json")
    ).select("job_id", F.substring("_json", F.lit(2), F.length("_json") - 2).alias("line"))
    label = F.regexp_extract("cluster_id", "_(\\d+)$", 1).cast("long")
    return array_document(clips.select("job_id").distinct(), {
        "face_clusters": (
            clusters.withColumn("ord", label),
            F.struct("cluster_id", "sample_count", _box_list("representative_bbox").alias("representative_bbox"), "thumbnail_path"),
        ),
        "observations": (
            observations.withColumn("ord", F.col("obs_id")),
            F.struct("timestamp", _box_list("bbox").alias("bbox"), "embedding", "lip_openness", "cluster_id", "source_video"),
        ),
    }, fixed)


def speakers_document(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """K5: speaker segments of each job."""
    return array_document(jobs, {
        "segments": (segments.withColumn("ord", F.col("seg_idx")), F.struct("speaker_id", "start", "end")),
    })


def face_sheet_rows(sheet: DataFrame) -> DataFrame:
    """K6: the seven report columns; write ordered by face_id."""
    return sheet.select(
        "job_id", "face_id", "name", "speaker_id", "match_confidence", "evidence_segments", "sample_count", "thumbnail_file"
    )


def intro_roster_rows(roster: DataFrame) -> DataFrame:
    """K7: the thirteen report columns; write ordered by timestamp."""
    order = ["ord"] if "ord" in roster.columns else []
    return roster.select(
        "job_id", *order, "name", "timestamp", "timecode", "location", "pronunciation", "name_spelling", "spelling_note",
        "clip_label", "face_id", F.col("match_confidence").alias("confidence"), "transcript", "thumbnail_file", "intro_clip_file",
    )


def write_table(rows: DataFrame, order: list[str], path: str, fmt: str, mode: str = "overwrite") -> None:
    """CSV with a header, or JSON lines, under ``job_id=<id>`` and ordered within each job."""
    arranged = rows.repartitionByRange("job_id", *order).sortWithinPartitions("job_id", *order)
    writer = arranged.write.mode(mode).partitionBy("job_id")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)


def labels_document(labels: DataFrame) -> DataFrame:
    """K8: one JSON object per job with the face ids as keys; as many keys as the job has faces."""
    pairs = F.array_sort(F.collect_list(F.struct("face_id", "name")))
    return labels.groupBy("job_id").agg(F.to_json(F.map_from_entries(pairs)).alias("line"))


def spoken_names_document(labels: DataFrame, detections: DataFrame, jobs: DataFrame) -> DataFrame:
    """K8: labels and all detections (with a unique integer ``ord``) of each job."""
    stored = jobs.join(labels_document(labels), "job_id", "left").select(
        "job_id", F.concat(F.lit('"labels": '), F.coalesce("line", F.lit("{}"))).alias("line")
    )
    record = F.struct(*[c for c in detections.columns if c not in ("job_id", "ord", "event_ord", "event_id")])
    return array_document(jobs, {"all_detections": (detections, record)}, stored)


def detections_document(detections: DataFrame, jobs: DataFrame) -> DataFrame:
    """K8: all detections (with a unique integer ``ord``) of each job as one array."""
    record = F.struct(*[c for c in detections.columns if c not in ("job_id", "ord", "event_ord", "event_id", "seg_idx")])
    firsts = detections.groupBy("job_id").agg(F.min("ord").alias("_first"))
    rows = join_facts(detections.select("job_id", F.col("ord").cast("long").alias("ord"), record.alias("_record")), firsts, ["job_id"], spread=["ord"])
    body = rows.select("job_id", F.lit(0).alias("section"), "ord", F.concat(F.when(F.col("ord") > F.col("_first"), ",").otherwise(""), F.to_json("_record")).alias("line"))
    edges = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(line).alias("line")) for s, line in ((-1, "["), (1, "]"))]))
    return body.unionByName(jobs.select("job_id", edges.alias("_edge")).select("job_id", "_edge.*"))


def screengrab_labels(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """K9 rows: chosen time, its timecode and the label of each visible face."""
    given = labels.select("job_id", F.col("face_id").alias("cluster_id"), F.col("name").alias("_label"))
    return faces.join(given, ["job_id", "cluster_id"], "left").select(
        "job_id", F.col("chosen_ts").alias("timestamp"), long_timecode(F.col("chosen_ts")).alias("timestamp_tc"),
        F.col("cluster_id").alias("face_id"), F.coalesce("_label", "cluster_id").alias("label"),
    ).distinct()


def screengrab_document(faces: DataFrame, labels: DataFrame, clips: DataFrame, chosen: DataFrame) -> DataFrame:
    """K9: one metadata object per job of ``chosen`` (job_id, chosen_ts), with empty labels where no face is near.

    The image itself is not drawn.
    """
    shown = screengrab_labels(faces, labels).groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("face_id", "label")))).alias("labels")
    )
    main = clips.filter("is_main").select("job_id", F.col("source_video").alias("video"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return chosen.join(shown, "job_id", "left").join(main, "job_id", "left").select(
        "job_id", F.to_json(F.struct(
            "video", F.col("chosen_ts").alias("timestamp"), long_timecode(F.col("chosen_ts")).alias("timestamp_tc"),
            F.coalesce("labels", none).alias("labels"),
        )).alias("line")
    )
