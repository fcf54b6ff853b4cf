"""Speaker to face queries: J1-J9, R1, R2, R7-R12, sink rows K1-K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import with_views
from rollcall.functions.scalars import long_timecode
from rollcall.operators import clustering, correlate, report, screengrab, vectors
from rollcall.sources import sinks

SEG = with_views("obs_v", "seg_v")
J1 = SEG + """,
j1 AS (SELECT s.job_id, s.seg_idx, s.speaker_id, o.obs_id, o.cluster_id, o.lip_openness
  FROM seg_v s JOIN obs_v o ON o.job_id = s.job_id AND o.ts_s BETWEEN s.start_s AND s.end_s WHERE o.cluster_id <> '')"""
J2 = J1 + """,
j2 AS (SELECT job_id, seg_idx, speaker_id, cluster_id, stddev_pop(lip_openness) + avg(lip_openness) AS score,
  min(obs_id) AS first_obs, count(*) AS samples FROM j1 GROUP BY ALL)"""
J3 = J2 + """,
j3 AS (SELECT job_id, seg_idx, speaker_id, cluster_id AS face_id FROM (SELECT *, row_number() OVER (
  PARTITION BY job_id, seg_idx ORDER BY round(score, 12) DESC, first_obs) AS rn FROM j2) q WHERE rn = 1)"""
J4 = J3 + """,
j4 AS (SELECT job_id, speaker_id, face_id, count(*) AS votes, min(seg_idx) AS first_seg FROM j3 GROUP BY ALL)"""
J5 = J4 + """,
j5 AS (SELECT job_id, speaker_id, face_id, votes / total AS confidence, votes AS evidence_segments, mapping_order
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, speaker_id ORDER BY votes DESC, first_seg) AS rn,
    sum(votes) OVER (PARTITION BY job_id, speaker_id) AS total,
    min(first_seg) OVER (PARTITION BY job_id, speaker_id) AS mapping_order FROM j4) q WHERE rn = 1)"""
J6 = J5 + """,
j6 AS (SELECT s.job_id, s.seg_idx, s.start_s, s.end_s, s.speaker_id, m.face_id, m.face_id AS name, m.confidence
  FROM seg_v s JOIN j5 m ON m.job_id = s.job_id AND m.speaker_id = s.speaker_id)"""
LABEL = J6 + ",\n" + with_views("label_v")[len("WITH "):]
J7 = LABEL + """,
j7 AS (SELECT t.job_id, t.seg_idx, t.start_s, t.end_s, t.speaker_id, t.face_id, coalesce(l.name, t.face_id) AS name, t.confidence
  FROM j6 t LEFT JOIN label_v l ON l.job_id = t.job_id AND l.face_id = t.face_id)"""


def long_tc(s: str) -> str:
    return (f"printf('%02d:%02d:%06.3f', CAST(floor({s} / 3600) AS BIGINT), CAST(floor(({s} % 3600) / 60) AS BIGINT), "
            f"round({s} % 60, 3))")


def thirds(t):
    mapped = correlate.correlate(t.obs, t.seg)
    return correlate.apply_labels(correlate.lower_thirds(t.seg, mapped), t.label)


@query("j1_segment_observations", J1 + " SELECT job_id, seg_idx, speaker_id, obs_id, cluster_id FROM j1")
def _(t):
    return correlate.segment_observations(t.obs, t.seg).select("job_id", "seg_idx", "speaker_id", "obs_id", "cluster_id")


@query("j2_lip_activity", J2 + " SELECT job_id, seg_idx, cluster_id, round(score, 6) AS score, first_obs, samples FROM j2")
def _(t):
    return correlate.lip_activity(correlate.segment_observations(t.obs, t.seg)).select(
        "job_id", "seg_idx", "cluster_id", F.round("score", 6).alias("score"), "first_obs", "samples"
    )


@query("j3_best_face", J3 + " SELECT * FROM j3")
def _(t):
    return correlate.best_face(correlate.lip_activity(correlate.segment_observations(t.obs, t.seg)))


@query("j4_votes", J4 + " SELECT * FROM j4")
def _(t):
    pairs = correlate.segment_observations(t.obs, t.seg)
    return correlate.votes(correlate.best_face(correlate.lip_activity(pairs)))


@query("j5_speaker_face_mappings", J5 + """ SELECT job_id, speaker_id, face_id, round(confidence, 6) AS confidence,
  evidence_segments, mapping_order FROM j5""")
def _(t):
    return correlate.correlate(t.obs, t.seg).withColumn("confidence", F.round("confidence", 6))


@query("j6_lower_thirds", J6 + """ SELECT job_id, seg_idx, start_s, end_s, speaker_id, face_id, name,
  round(confidence, 6) AS confidence FROM j6""")
def _(t):
    rows = correlate.lower_thirds(t.seg, correlate.correlate(t.obs, t.seg))
    return rows.select(
        "job_id", "seg_idx", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "speaker_id", "face_id",
        "name", F.round("confidence", 6).alias("confidence"),
    )


@query("j7_apply_labels", J7 + " SELECT job_id, seg_idx, speaker_id, face_id, name FROM j7")
def _(t):
    return thirds(t).select("job_id", "seg_idx", "speaker_id", "face_id", "name")


@query("lower_third_timeline", J7 + f""" SELECT job_id, seg_idx, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s,
  {long_tc('start_s')} AS start_tc, {long_tc('end_s')} AS end_tc, name, speaker_id, face_id,
  round(confidence, 3) AS confidence FROM j7""")
def lower_third_timeline(t):
    """K2 rows: who is on screen, when and under which name."""
    return sinks.lower_third_csv_rows(thirds(t)).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("k1_lower_third_json", J7 + """ SELECT job_id, seg_idx, start_s, end_s, name, speaker_id, face_id,
  round(confidence, 3) AS confidence FROM j7""")
def _(t):
    return sinks.lower_third_json_rows(thirds(t)).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("k3_edl_markers", J7 + f""", n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS num FROM j7)
SELECT job_id, -1 AS event_no, 0 AS part, 'TITLE: Lower Third Markers' AS line FROM (SELECT DISTINCT job_id FROM j7) q
UNION ALL SELECT job_id, -1, 1, 'FCM: NON-DROP FRAME' FROM (SELECT DISTINCT job_id FROM j7) q
UNION ALL SELECT job_id, num, 0, printf('%03d  AX       V     C        ', num) || {long_tc('start_s')} || ' ' || {long_tc('end_s')}
  || ' ' || {long_tc('start_s')} || ' ' || {long_tc('end_s')} FROM n
UNION ALL SELECT job_id, num, 1, '* FROM CLIP NAME: ' || name FROM n
UNION ALL SELECT job_id, num, 2, '* COMMENT: speaker=' || speaker_id || ' face=' || face_id || ' confidence='
  || printf('%.2f', round(confidence, 2)) FROM n""")
def _(t):
    return sinks.edl_lines(thirds(t)).select("job_id", "event_no", "part", "line")


@query("j8_observations_near", SEG + """, c AS (SELECT DISTINCT job_id, 50.2E0 AS chosen_ts FROM obs_v)
SELECT job_id, cluster_id, obs_id, ts_s, x1, y1, x2, y2 FROM (SELECT o.*, row_number() OVER (
  PARTITION BY o.job_id, o.cluster_id ORDER BY abs(o.ts_s - c.chosen_ts), o.obs_id) AS rn
  FROM obs_v o JOIN c ON c.job_id = o.job_id WHERE o.cluster_id <> '' AND abs(o.ts_s - c.chosen_ts) <= 0.6) q WHERE rn = 1""")
def _(t):
    chosen = t.obs.select("job_id").distinct().withColumn("chosen_ts", F.lit(50.2))
    return screengrab.observations_near(t.obs, chosen).select(
        "job_id", "cluster_id", "obs_id", F.col("timestamp").alias("ts_s"), "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2"
    )


CLIPS_SQL = """clips AS (SELECT job_id, source_video, source_video = 'clip_0' AS is_main,
  max(ts_s) AS duration_s FROM obs_v GROUP BY job_id, source_video)"""


def clips(t):
    return t.obs.groupBy("job_id", "source_video").agg(F.max("timestamp").alias("duration_s")).withColumn(
        "is_main", F.col("source_video") == "clip_0"
    )


@query("j9_extra_clips", with_views("obs_v") + ",\n" + CLIPS_SQL + """
SELECT job_id, source_video FROM clips c WHERE NOT EXISTS (SELECT 1 FROM clips m WHERE m.job_id = c.job_id
  AND m.source_video = c.source_video AND m.is_main)""")
def _(t):
    return correlate.extra_clips(clips(t)).select("job_id", "source_video")


R1 = J5 + """,
r1 AS (SELECT job_id, face_id, speaker_id, confidence, evidence_segments FROM (SELECT *, row_number() OVER (
  PARTITION BY job_id, face_id ORDER BY mapping_order DESC) AS rn FROM j5) q WHERE rn = 1)"""


@query("r1_speaker_per_face", R1 + """ SELECT job_id, face_id, speaker_id, round(confidence, 6) AS confidence,
  evidence_segments FROM r1""")
def _(t):
    return report.speaker_per_face(correlate.correlate(t.obs, t.seg)).withColumn("confidence", F.round("confidence", 6))


R2 = R1 + ",\n" + with_views("label_v")[len("WITH "):] + """,
clu AS (SELECT job_id, cluster_id AS face_id, count(*) AS sample_count FROM obs_v WHERE cluster_id <> '' GROUP BY ALL),
r2 AS (SELECT c.job_id, c.face_id, coalesce(nullif(l.name, ''), 'Name not detected') AS name,
  coalesce(r.speaker_id, '') AS speaker_id, round(coalesce(r.confidence, 0), 3) AS match_confidence,
  coalesce(r.evidence_segments, 0) AS evidence_segments, c.sample_count,
  'face_thumbnails/' || c.face_id || '.jpg' AS thumbnail_file
  FROM clu c LEFT JOIN r1 r ON r.job_id = c.job_id AND r.face_id = c.face_id
  LEFT JOIN label_v l ON l.job_id = c.job_id AND l.face_id = c.face_id)"""


def sheet(t):
    return report.face_sheet(clustering.cluster_summary(t.obs), correlate.correlate(t.obs, t.seg), t.label)


@query("r2_face_sheet", R2 + " SELECT * FROM r2")
def _(t):
    return sheet(t)


@query("r9_card_lines", R2 + """ SELECT job_id, face_id, 'Face ID: ' || face_id || '|Speaker: '
  || coalesce(nullif(speaker_id, ''), '—') || '|Samples seen: ' || sample_count AS lines FROM r2""")
def _(t):
    cards = report.card_lines(sheet(t))
    lines = F.filter("card_lines", lambda line: ~line.startswith("Match confidence"))
    return cards.select("job_id", "face_id", F.array_join(lines, "|").alias("lines"))


@query("r7_job_summary", SEG + ",\n" + CLIPS_SQL + """
SELECT c.job_id, c.clip_count, c.extra_video_count, f.n AS face_cluster_count, s.n AS speaker_segment_count
FROM (SELECT job_id, count(*) AS clip_count, count(*) FILTER (NOT is_main) AS extra_video_count FROM clips GROUP BY job_id) c
JOIN (SELECT job_id, count(DISTINCT cluster_id) AS n FROM obs_v WHERE cluster_id <> '' GROUP BY job_id) f ON f.job_id = c.job_id
JOIN (SELECT job_id, count(*) AS n FROM seg_v GROUP BY job_id) s ON s.job_id = c.job_id""")
def _(t):
    return report.job_summary(clips(t), clustering.cluster_summary(t.obs), t.seg)


@query("r8_estimated_people", SEG + """ SELECT job_id, count(DISTINCT cluster_id) AS estimated_people
  FROM obs_v WHERE cluster_id <> '' GROUP BY job_id""")
def _(t):
    return report.estimated_people(clustering.cluster_summary(t.obs))


R10 = with_views("obs_v") + """,
f AS (SELECT job_id, ts_s, 10 * count(DISTINCT cluster_id) + count(*) AS score, min(obs_id) AS first_obs
  FROM obs_v WHERE cluster_id <> '' GROUP BY job_id, ts_s),
r10 AS (SELECT job_id, ts_s, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, first_obs) AS rn
  FROM f) q WHERE rn = 1)"""


@query("r10_best_frame", R10 + " SELECT * FROM r10")
def _(t):
    return screengrab.best_frames(t.obs).withColumnRenamed("timestamp", "ts_s")


R11 = R10 + """,
cent AS (SELECT job_id, cluster_id, list(m ORDER BY pos) AS centroid, min(fo) AS ord FROM (
  SELECT job_id, cluster_id, pos, avg(v) AS m, min(obs_id) AS fo FROM (
    SELECT job_id, cluster_id, obs_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM obs_v
    WHERE cluster_id <> '') e GROUP BY job_id, cluster_id, pos) a GROUP BY job_id, cluster_id)"""


@query("r11_frame_faces", R10 + """,
n AS (SELECT o.*, row_number() OVER (PARTITION BY o.job_id, o.cluster_id ORDER BY abs(o.ts_s - r.ts_s), o.obs_id) AS rn
  FROM obs_v o JOIN r10 r ON r.job_id = o.job_id WHERE o.cluster_id <> '' AND abs(o.ts_s - r.ts_s) <= 0.6)
SELECT job_id, cluster_id, obs_id FROM n WHERE rn = 1""")
def _(t):
    chosen = screengrab.best_frames(t.obs).select("job_id", F.col("timestamp").alias("chosen_ts"))
    return screengrab.frame_faces(t.obs, chosen, vectors.centroids(t.obs)).select("job_id", "cluster_id", "obs_id")


@query("r11_unclustered_frame", R11 + """,
j AS (SELECT DISTINCT job_id FROM obs_v),
near AS (SELECT DISTINCT job_id FROM obs_v WHERE cluster_id <> '' AND abs(ts_s - 45.0E0) <= 0.1E0),
fr AS (SELECT o.* FROM obs_v o WHERE abs(o.ts_s - 45.0E0) <= 0.1E0 AND o.job_id NOT IN (SELECT job_id FROM near)),
lone AS (SELECT job_id, cluster_id, obs_id FROM (SELECT o.job_id, o.cluster_id, o.obs_id, row_number() OVER (
  PARTITION BY o.job_id, o.cluster_id ORDER BY abs(o.ts_s - 45.0E0), o.obs_id) AS rn FROM obs_v o
  WHERE o.cluster_id <> '' AND abs(o.ts_s - 45.0E0) <= 0.1E0) q WHERE rn = 1),
cos AS (SELECT f.job_id, c.cluster_id, f.obs_id, row_number() OVER (PARTITION BY f.job_id, f.obs_id ORDER BY
  1.0 - list_inner_product(CAST(f.embedding AS DOUBLE[]), c.centroid) / (sqrt(list_inner_product(CAST(f.embedding AS DOUBLE[]),
    CAST(f.embedding AS DOUBLE[]))) * sqrt(list_inner_product(c.centroid, c.centroid)) + 1e-8), c.ord) AS rn
  FROM fr f JOIN cent c ON c.job_id = f.job_id)
SELECT * FROM lone UNION ALL SELECT job_id, cluster_id, obs_id FROM cos WHERE rn = 1""")
def _(t):
    """A given time at which some jobs have no clustered face."""
    chosen = t.obs.select("job_id").distinct().withColumn("chosen_ts", F.lit(45.0))
    faces = screengrab.frame_faces(t.obs, chosen, vectors.centroids(t.obs), tolerance_s=0.1)
    return faces.select("job_id", "cluster_id", "obs_id")


@query("r12_captions", with_views("obs_v", "label_v") + """
SELECT o.job_id, o.obs_id, coalesce(l.name, nullif(o.cluster_id, ''), 'Unknown') AS caption
FROM obs_v o LEFT JOIN label_v l ON l.job_id = o.job_id AND l.face_id = o.cluster_id""")
def _(t):
    return screengrab.captions(t.obs, t.label).select("job_id", "obs_id", "caption")


@query("k9_screengrab_labels", R10 + ",\n" + with_views("label_v")[len("WITH "):] + f""",
n AS (SELECT DISTINCT o.job_id, o.cluster_id, r.ts_s FROM obs_v o JOIN r10 r ON r.job_id = o.job_id
  WHERE o.cluster_id <> '' AND abs(o.ts_s - r.ts_s) <= 0.6)
SELECT n.job_id, n.ts_s, {long_tc('n.ts_s')} AS timestamp_tc, n.cluster_id AS face_id, coalesce(l.name, n.cluster_id) AS label
FROM n LEFT JOIN label_v l ON l.job_id = n.job_id AND l.face_id = n.cluster_id""")
def _(t):
    chosen = screengrab.best_frames(t.obs).select("job_id", F.col("timestamp").alias("chosen_ts"))
    faces = screengrab.frame_faces(t.obs, chosen, vectors.centroids(t.obs))
    return sinks.screengrab_labels(faces, t.label).withColumnRenamed("timestamp", "ts_s")


@query("s7_labels_in_force", with_views("label_v") + """
SELECT job_id, face_id, name FROM label_v WHERE job_id <> 'job_1'
UNION ALL SELECT 'job_1', 'face_' || r_regionkey, r_name FROM region""")
def _(t):
    given = t.table("region").selectExpr("'job_1' AS job_id", "concat('face_', r_regionkey) AS face_id", "r_name AS name")
    return report.labels_in_force(t.label, given)


@query("f1_long_timecode", f"SELECT event_id, {long_tc('value * 37')} AS tc FROM events")
def _(t):
    return t.table("events").select("event_id", long_timecode(F.col("value") * 37).alias("tc"))
