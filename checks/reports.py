"""Report rows and documents: R3-R6, K4, K5, K8, and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.names import HEARD, STORED, details_cte, stored
from checks.registry import query
from checks.speakers import J6, R2, SEG, sheet
from checks.views import with_views
from rollcall.operators import clustering, correlate, names, report
from rollcall.session import shared_folder
from rollcall.sources import documents, sinks, structural

# Detections: T19 rows of every segment, with some columns missing on purpose.
DETECTED = HEARD + ",\n" + STORED + """,
based AS (SELECT s.*, coalesce(h.name, s.name) AS base FROM stored s LEFT JOIN (SELECT job_id, seg_idx, name FROM heard WHERE name_idx = 0) h
  ON h.job_id = s.job_id AND h.seg_idx = s.seg_idx),
""" + details_cte("based", "job_id, seg_idx, ts_s, transcript, name_heard AS earlier", "transcript", "base", "''") + """,
r3 AS (SELECT job_id, seg_idx AS ord, display_name AS name, coalesce(name_heard, earlier, '') AS name_heard, round(ts_s, 1) AS ts_s,
  round(seg_idx * 1.25, 1) AS match_confidence, transcript, location, name_spelling, spelling_note, pronunciation, '' AS clip_label, 0 AS intro_clip_faces_visible,
  FALSE AS intro_clip_includes_full_cast FROM d7)"""
R3_COLUMNS = """job_id, ord, name, name_heard, ts_s, match_confidence, transcript, location, name_spelling, spelling_note, pronunciation, clip_label,
  intro_clip_faces_visible, intro_clip_includes_full_cast"""


def detections(t):
    return names.enrich_detections(stored(t)).withColumn("ord", F.col("seg_idx")).withColumn("confidence", F.col("seg_idx") * 1.25)


@query("r3_detection_rows", DETECTED + f" SELECT {R3_COLUMNS} FROM r3")
def _(t):
    rows = report.detection_rows(detections(t)).withColumnRenamed("timestamp", "ts_s")
    return rows.select(*[c.strip() for c in R3_COLUMNS.split(",")])


@query("r4_intro_roster", DETECTED + """ SELECT job_id, ord, name, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60)
  ELSE printf('%d:%02d', s // 60, s % 60) END AS timecode FROM (SELECT *, CAST(round_even(ts_s, 0) AS BIGINT) AS s FROM r3) q""")
def _(t):
    return report.intro_roster(detections(t)).select("job_id", "ord", "name", "timecode")


@query("r5_detail_lines", DETECTED + """ SELECT job_id, ord, array_to_string([x for x in [CASE WHEN location <> '' THEN 'From: ' || location END,
  CASE WHEN pronunciation <> '' THEN 'Pronunciation: ' || pronunciation END, CASE WHEN name_spelling <> '' THEN 'Spelling: ' || name_spelling END,
  CASE WHEN name_heard <> '' AND name_heard <> name THEN 'Heard as: ' || name_heard END, CASE WHEN spelling_note <> '' THEN spelling_note END]
  if x is not null], '|') AS lines FROM r3""")
def _(t):
    rows = report.detail_lines(report.detection_rows(detections(t)))
    return rows.select("job_id", "ord", F.array_join("detail_lines", "|").alias("lines"))


@query("r6_truncated_labels", "SELECT doc_id, CASE WHEN length(text) > 34 THEN left(text, 31) || '...' ELSE text END AS label FROM documents")
def _(t):
    return t.table("documents").select("doc_id", report.truncated(F.col("text")).alias("label"))


@query("k5_speakers_document", SEG + """, jobs AS (SELECT DISTINCT job_id FROM seg_v)
SELECT job_id, 0 AS section, CASE WHEN seg_idx > min(seg_idx) OVER (PARTITION BY job_id) THEN ',' ELSE '' END || '{"speaker_id":"' || speaker_id || '"' AS line FROM seg_v
UNION ALL SELECT job_id, -1, '{' FROM jobs UNION ALL SELECT job_id, 0, '"segments": [' FROM jobs UNION ALL SELECT job_id, 0, ']' FROM jobs
UNION ALL SELECT job_id, 1, '}' FROM jobs""")
def _(t):
    lines = sinks.speakers_document(t.seg, t.seg.select("job_id").distinct())
    return lines.select("job_id", "section", F.regexp_replace("line", ',"start.*$', "").alias("line"))


@query("k4_correlation_document", J6 + """,
jobs AS (SELECT DISTINCT job_id FROM seg_v),
body AS (SELECT job_id, 0 AS section, mapping_order AS ord, '{"speaker_id":"' || speaker_id || '","face_id":"' || face_id || '"' AS line FROM j5
  UNION ALL SELECT job_id, 1, seg_idx, '{"speaker_id":"' || speaker_id || '","face_id":"' || face_id || '"' FROM j6),
f AS (SELECT *, row_number() OVER (PARTITION BY job_id, section ORDER BY ord) AS rn FROM body)
SELECT job_id, section, CASE WHEN rn > 1 THEN ',' ELSE '' END || line AS line FROM f
UNION ALL SELECT job_id, -1, '{' FROM jobs UNION ALL SELECT job_id, 0, '"speaker_face_mappings": [' FROM jobs UNION ALL SELECT job_id, 0, '],' FROM jobs
UNION ALL SELECT job_id, 1, '"lower_thirds": [' FROM jobs UNION ALL SELECT job_id, 1, ']' FROM jobs UNION ALL SELECT job_id, 2, '}' FROM jobs""")
def _(t):
    """The document's lines; numbers are left out of the compared text because engines print them differently."""
    mapped = correlate.correlate(t.obs, t.seg)
    jobs = t.seg.select("job_id").distinct()
    lines = sinks.correlation_document(mapped, correlate.lower_thirds(t.seg, mapped), jobs)
    pair = F.regexp_extract("line", '^(,?).*("speaker_id":"[^"]*"),("face_id":"[^"]*")', 0)
    parts = [F.regexp_extract("line", '("speaker_id":"[^"]*"),("face_id":"[^"]*")', i) for i in (1, 2)]
    comma = F.when(F.col("line").startswith(","), ",").otherwise("")
    return lines.select(
        "job_id", "section",
        F.when(pair == "", F.col("line")).otherwise(F.concat(comma, F.lit("{"), parts[0], F.lit(","), parts[1])).alias("line"),
    )


@query("k8_labels_document", with_views("label_v") + """ SELECT job_id, '{' || string_agg('"' || face_id || '":"' || name || '"', ',' ORDER BY face_id) || '}' AS line
  FROM label_v GROUP BY job_id""")
def _(t):
    return sinks.labels_document(t.label)


#: Part files of one job's folder are one document.
PARTS = "part-*"


def written(t, lines):
    """Writes numbered document lines as files, one folder per job, and returns where."""
    folder = f"{shared_folder(t.spark)}/documents-{uuid.uuid4().hex}"
    sinks.write_lines(lines, ["section", "ord"], folder)
    return folder


@query("s5_speaker_segments", SEG + """ SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) - 1 AS seg_idx, speaker_id, start_s, end_s FROM seg_v""")
def _(t):
    folder = written(t, sinks.speakers_document(t.seg, t.seg.select("job_id").distinct()))
    return documents.read_speaker_segments(t.spark, folder, PARTS).withColumnsRenamed({"start": "start_s", "end": "end_s"})


def correlation_lines(t):
    mapped = correlate.correlate(t.obs, t.seg)
    return sinks.correlation_document(mapped, correlate.lower_thirds(t.seg, mapped), t.seg.select("job_id").distinct())


@query("s6_mappings", J6 + """ SELECT job_id, speaker_id, face_id, round(confidence, 9) AS confidence, evidence_segments,
  row_number() OVER (PARTITION BY job_id ORDER BY mapping_order) - 1 AS mapping_order FROM j5""")
def _(t):
    rows = documents.read_mappings(t.spark, written(t, correlation_lines(t)), PARTS)
    return rows.withColumn("confidence", F.round("confidence", 9))


@query("s6_lower_thirds", J6 + """ SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) - 1 AS seg_idx, start_s, end_s, speaker_id, face_id, name,
  round(confidence, 9) AS confidence FROM j6""")
def _(t):
    rows = documents.read_lower_thirds(t.spark, written(t, correlation_lines(t)), PARTS)
    return rows.withColumnsRenamed({"start": "start_s", "end": "end_s"}).withColumn("confidence", F.round("confidence", 9))


def face_lines(t):
    clips = t.obs.select("job_id", "source_video").distinct().selectExpr(
        "job_id", "CAST(substr(source_video, 6) AS INT) AS clip_idx", "source_video", "source_video = 'clip_0' AS is_main")
    return sinks.faces_document(clips, clustering.cluster_summary(t.obs), t.obs, clustering.noise_counts(t.obs.withColumn("was_noise", F.lit(False))))


@query("s4_observations", with_views("obs_v") + """ SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY obs_id) - 1 AS obs_id, source_video, ts_s, x1, y1, x2, y2,
  round(CAST(embedding[1] AS DOUBLE), 4) AS first_value, len(embedding) AS dimensions, round(lip_openness, 6) AS lip, cluster_id FROM obs_v""")
def _(t):
    return documents.read_observations(t.spark, written(t, face_lines(t)), PARTS).select(
        "job_id", "obs_id", "source_video", F.col("timestamp").alias("ts_s"), "bbox.*", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value"),
        F.size("embedding").alias("dimensions"), F.round("lip_openness", 6).alias("lip"), "cluster_id")


@query("k5_faces_document", with_views("obs_v") + """ SELECT job_id, 'clip_0' AS video, count(DISTINCT source_video) AS clips, count(*) AS observations,
  count(DISTINCT cluster_id) FILTER (cluster_id <> '') AS face_clusters, count(DISTINCT cluster_id) FILTER (cluster_id <> '') AS estimated_people, 0 AS noise_count
  FROM obs_v GROUP BY job_id""")
def _(t):
    folder = written(t, face_lines(t))
    clusters, rows = documents.read_clusters(t.spark, folder, PARTS), documents.read_observations(t.spark, folder, PARTS)
    every = documents.read_face_envelopes(t.spark, folder, PARTS).join(
        clusters.groupBy("job_id").agg(F.count("cluster_id").alias("face_clusters")), "job_id", "left"
    ).join(rows.groupBy("job_id").agg(F.count("timestamp").alias("observations")), "job_id", "left")
    return every.select(
        "job_id", "video", F.size("sampled_videos").alias("clips"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observations", "face_clusters")],
        "estimated_people", "noise_count")


@query("s8_detections", DETECTED + """ SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS ord, name, transcript, location, name_spelling FROM r3""")
def _(t):
    rows = detections(t)
    folder = written(t, sinks.detections_document(rows, rows.select("job_id").distinct()))
    return documents.read_detections(t.spark, folder, PARTS).select(
        "job_id", "ord", "name", "transcript", *[F.coalesce(c, F.lit("")).alias(c) for c in ("location", "name_spelling")])


@query("k8_spoken_names_document", DETECTED + """ SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS place, name, ts_s FROM r3""")
def _(t):
    rows = detections(t)
    folder = written(t, sinks.spoken_names_document(t.label, rows, rows.select("job_id").distinct()))
    found, _ = structural.read_documents(t.spark, f"{folder}/*/{PARTS}", {"all_detections"})
    parsed = F.from_json("text", "name string, timestamp double", {"mode": "FAILFAST"})
    return found.select("job_id", "place", parsed.alias("d")).select("job_id", "place", "d.name", F.round("d.timestamp", 1).alias("ts_s"))


@query("k7_intro_roster", DETECTED + """ SELECT job_id, ord, name, ts_s, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60)
  ELSE printf('%d:%02d', s // 60, s % 60) END AS timecode, location, pronunciation, name_spelling, spelling_note, clip_label, '' AS face_id,
  match_confidence AS confidence, transcript, '' AS thumbnail_file, '' AS intro_clip_file FROM (SELECT *, CAST(round_even(ts_s, 0) AS BIGINT) AS s FROM r3) q""")
def _(t):
    return sinks.intro_roster_rows(report.intro_roster(detections(t))).withColumnRenamed("timestamp", "ts_s")


@query("k6_face_sheet_rows", R2 + """ SELECT job_id, face_id, name, speaker_id, match_confidence, evidence_segments, sample_count, thumbnail_file FROM r2""")
def _(t):
    return sinks.face_sheet_rows(sheet(t))
