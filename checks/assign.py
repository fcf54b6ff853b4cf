"""Name to face assignment queries: A1-A12."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.clusters import EUCLID, _nearest
from checks.registry import query
from checks.views import with_views
from rollcall.operators import assign, vectors
from rollcall.operators.clips import SEARCH_OFFSETS

# Frames are the distinct times of the observations, some of them dark.
FRAMES = """fr AS (SELECT DISTINCT job_id, source_video, ts_s, (CAST(ts_s * 2 AS BIGINT) % 7) * 4.0E0 AS brightness FROM obs_v),
faces AS (SELECT job_id, source_video, ts_s, cluster_id AS face_id, max(score) AS score, arg_max(obs_id, (score, -obs_id)) AS obs_id, count(*) AS seen
  FROM (SELECT *, lip_openness * 1000.0 + CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS score FROM obs_v WHERE cluster_id <> '') q GROUP BY ALL)"""
ORDERED = """ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_s, confidence DESC, event_id) AS r FROM event_v),
onf AS (SELECT job_id, event_id, r, source_video, frame_ts FROM (SELECT e.*, f.ts_s AS frame_ts, row_number() OVER (PARTITION BY e.job_id, e.event_id
  ORDER BY abs(f.ts_s - e.ts_s), f.ts_s) AS rn FROM ev e JOIN fr f ON f.job_id = e.job_id AND f.source_video = e.source_video
  AND abs(f.ts_s - e.ts_s) <= 0.5) q WHERE rn = 1),
ranked AS (SELECT o.job_id, o.event_id, f.face_id, f.score, f.obs_id, f.seen, row_number() OVER (PARTITION BY o.job_id, o.event_id
  ORDER BY f.score DESC, f.obs_id) AS face_rank FROM onf o JOIN faces f ON f.job_id = o.job_id AND f.source_video = o.source_video AND f.ts_s = o.frame_ts)"""
BASE = with_views("obs_v", "event_v", recursive=True) + ",\n" + FRAMES + ",\n" + ORDERED
OFFSETS = ", ".join(f"({i}, {o}::DOUBLE)" for i, o in enumerate(SEARCH_OFFSETS))
CAPTURES = f""",
off AS (SELECT * FROM (VALUES {OFFSETS}) v(offset_rank, off)),
probe AS (SELECT e.job_id, e.event_id, e.source_video, o.offset_rank, e.ts_s + o.off AS at FROM ev e CROSS JOIN off o WHERE e.ts_s + o.off >= 0),
shot AS (SELECT * FROM (SELECT p.*, f.ts_s AS frame_ts, f.brightness, row_number() OVER (PARTITION BY p.job_id, p.event_id, p.offset_rank
  ORDER BY abs(f.ts_s - p.at), f.ts_s) AS rn FROM probe p JOIN fr f ON f.job_id = p.job_id AND f.source_video = p.source_video
  AND f.ts_s BETWEEN p.at - 0.5 AND p.at + 0.5) q WHERE rn = 1 AND brightness >= 12),
cap AS (SELECT s.job_id, s.event_id, s.offset_rank, s.frame_ts, f.face_id, f.score, f.obs_id FROM shot s JOIN faces f
  ON f.job_id = s.job_id AND f.source_video = s.source_video AND f.ts_s = s.frame_ts)"""


def fold(lists: str) -> str:
    """Events of a job one by one, each taking its first free face."""
    return f""",
lists AS ({lists}),
step AS (SELECT e.job_id, e.event_id, e.r, coalesce(l.faces, []) AS faces, coalesce(l.scores, []) AS scores FROM ev e
  LEFT JOIN lists l ON l.job_id = e.job_id AND l.event_id = e.event_id),
walk AS (SELECT job_id, event_id, r, faces, scores, CAST([] AS VARCHAR[]) AS before, faces[1] AS face FROM step WHERE r = 1
  UNION ALL SELECT s.job_id, s.event_id, s.r, s.faces, s.scores,
    CASE WHEN w.face IS NULL THEN w.before ELSE list_append(w.before, w.face) END,
    list_filter(s.faces, lambda f: NOT list_contains(CASE WHEN w.face IS NULL THEN w.before ELSE list_append(w.before, w.face) END, f))[1]
  FROM walk w JOIN step s ON s.job_id = w.job_id AND s.r = w.r + 1),
won AS (SELECT job_id, event_id, r, face AS face_id, scores[list_position(faces, face)] AS lip_score FROM walk WHERE face IS NOT NULL)"""


OWN = "SELECT job_id, event_id, list(face_id ORDER BY face_rank) AS faces, list(score ORDER BY face_rank) AS scores FROM ranked GROUP BY ALL"
BOTH = """SELECT job_id, event_id, list(face_id ORDER BY o, a, b, c) AS faces, list(score ORDER BY o, a, b, c) AS scores FROM (
  SELECT job_id, event_id, face_id, score, -1 AS o, face_rank AS a, 0.0 AS b, 0 AS c FROM ranked
  UNION ALL SELECT job_id, event_id, face_id, 0.0, offset_rank, 0, -score, obs_id FROM cap) q GROUP BY ALL"""
A2 = BASE + fold(OWN)
A8 = BASE + CAPTURES + fold(BOTH)


def events(t):
    return t.event.withColumn("event_ord", F.struct("timestamp", (-F.col("confidence")).alias("low"), "event_id"))


def frames(t):
    dark = (F.col("timestamp") * 2).cast("long") % 7 * 4.0
    return t.obs.select("job_id", "source_video", "timestamp").distinct().withColumn("brightness", dark)


def ranked(t):
    return assign.rank_faces(events(t), frames(t), assign.faces_on_frames(t.obs))


def captures(t):
    return assign.probe_captures(events(t), frames(t), assign.faces_on_frames(t.obs))


def pictures(t):
    return t.obs.filter("cluster_id IN ('face_0', 'face_1', 'face_2')").select("job_id", F.col("cluster_id").alias("face_id")).distinct()


PICTURES = "pic AS (SELECT DISTINCT job_id, cluster_id AS face_id FROM obs_v WHERE cluster_id IN ('face_0', 'face_1', 'face_2'))"


@query("a1_rank_faces", _nearest(EUCLID) + ",\n" + with_views("event_v")[len("WITH "):] + """,
ev AS (SELECT * FROM event_v),
fr AS (SELECT DISTINCT job_id, source_video, ts_s FROM obs_v),
onf AS (SELECT job_id, event_id, source_video, frame_ts FROM (SELECT e.*, f.ts_s AS frame_ts, row_number() OVER (PARTITION BY e.job_id, e.event_id
  ORDER BY abs(f.ts_s - e.ts_s), f.ts_s) AS rn FROM ev e JOIN fr f ON f.job_id = e.job_id AND f.source_video = e.source_video
  AND abs(f.ts_s - e.ts_s) <= 0.5) q WHERE rn = 1),
m AS (SELECT o.job_id, o.source_video, o.ts_s, n.nearest AS face_id, max(o.lip_openness * 1000.0 + CAST(o.x2 - o.x1 AS DOUBLE) * (o.y2 - o.y1)) AS score,
  count(*) AS seen FROM obs_v o JOIN n ON n.job_id = o.job_id AND n.obs_id = o.obs_id AND n.rn = 1 GROUP BY ALL)
SELECT o.job_id, o.event_id, m.face_id, round(m.score, 6) AS score, m.seen FROM onf o
JOIN m ON m.job_id = o.job_id AND m.source_video = o.source_video AND m.ts_s = o.frame_ts""")
def _(t):
    matched = vectors.nearest_cluster(t.obs, vectors.centroids(t.obs))
    rows = assign.rank_faces(events(t), frames(t), assign.faces_on_frames(matched))
    return rows.select("job_id", "event_id", "face_id", F.round("score", 6).alias("score"), "seen")


@query("a1_rank_order", BASE + " SELECT job_id, event_id, face_id, face_rank FROM ranked")
def _(t):
    return ranked(t).select("job_id", "event_id", "face_id", "face_rank")


@query("a2_assign_faces", A2 + " SELECT job_id, event_id, face_id, round(lip_score, 6) AS lip_score FROM won")
def _(t):
    return assign.assign_faces(events(t), ranked(t)).select("job_id", "event_id", "face_id", F.round("lip_score", 6).alias("lip_score"))


@query("a3_fallback_flag", A2 + """
SELECT w.job_id, w.event_id, coalesce(w.face, '') AS face_id, (coalesce(o.lip_score, 0) <= 0 OR coalesce(c.visible > 1
  AND list_contains(w.before, w.faces[1]), FALSE)) AS allow_fallback FROM walk w
LEFT JOIN won o ON o.job_id = w.job_id AND o.event_id = w.event_id
LEFT JOIN (SELECT job_id, event_id, sum(seen) AS visible FROM ranked GROUP BY ALL) c ON c.job_id = w.job_id AND c.event_id = w.event_id""")
def _(t):
    order, faces = events(t), ranked(t)
    flagged = assign.with_fallback_flag(order, faces, assign.assign_faces(order, faces))
    return flagged.select("job_id", "event_id", "face_id", "allow_fallback")


@query("a4_probe_captures", BASE + CAPTURES + " SELECT job_id, event_id, offset_rank, frame_ts, face_id, obs_id FROM cap")
def _(t):
    return captures(t).select("job_id", "event_id", "offset_rank", "frame_ts", "face_id", "obs_id")


@query("a5_pick_capture", BASE + CAPTURES + """ SELECT job_id, event_id, face_id, frame_ts, obs_id FROM (SELECT *, row_number() OVER (
  PARTITION BY job_id, event_id ORDER BY offset_rank, score DESC, obs_id) AS rn FROM cap) q WHERE rn = 1""")
def _(t):
    return assign.pick_capture(captures(t)).select("job_id", "event_id", "face_id", "frame_ts", "obs_id")


@query("a8_late_faces", A8 + " SELECT job_id, event_id, face_id, round(lip_score, 6) AS lip_score FROM won")
def _(t):
    found = assign.assign_faces(events(t), ranked(t), captures(t))
    return found.select("job_id", "event_id", "face_id", F.round("lip_score", 6).alias("lip_score"))


TRIES = A8 + """,
pref AS (SELECT w.job_id, w.event_id, e.face_id AS preferred_face, list_sort(w.before) AS taken, e.lip_score FROM walk w
  JOIN event_v e ON e.job_id = w.job_id AND e.event_id = w.event_id),
cand AS (SELECT job_id, event_id, 0 AS o, taken AS excluded FROM pref WHERE preferred_face = ''
  UNION ALL SELECT job_id, event_id, 1000 - CAST(split_part(f, '_', 2) AS INT), [f] FROM (SELECT job_id, event_id, unnest(taken) AS f FROM pref WHERE preferred_face = '') u
  UNION ALL SELECT job_id, event_id, 9999, [] FROM pref),
tries AS (SELECT job_id, event_id, excluded, row_number() OVER (PARTITION BY job_id, event_id ORDER BY o) - 1 AS attempt FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, event_id, excluded ORDER BY o) AS rn FROM cand) q WHERE rn = 1)"""


def wanted(t):
    """Events with their stored face preferred and the faces taken before them."""
    order = events(t)
    taken = assign.taken_before(order, assign.assign_faces(order, ranked(t), captures(t)))
    stored = t.event.select("job_id", "event_id", F.col("face_id").alias("preferred_face"), (F.col("lip_score") <= 0).alias("allow_fallback"))
    return stored.join(taken, ["job_id", "event_id"])


@query("a6_exclusion_attempts", TRIES + " SELECT job_id, event_id, attempt, array_to_string(excluded, '|') AS excluded FROM tries")
def _(t):
    return assign.exclusion_attempts(wanted(t)).select("job_id", "event_id", "attempt", F.array_join("excluded", "|").alias("excluded"))


def chosen_sql(pref: str, tries: str) -> str:
    return f""",
hit AS (SELECT job_id, event_id, face_id, frame_ts FROM (SELECT c.*, row_number() OVER (PARTITION BY c.job_id, c.event_id
  ORDER BY t.attempt, c.offset_rank, c.score DESC, c.obs_id) AS rn FROM cap c JOIN {tries} t ON t.job_id = c.job_id AND t.event_id = c.event_id
  JOIN {pref} p ON p.job_id = c.job_id AND p.event_id = c.event_id WHERE CASE WHEN p.preferred_face <> '' THEN c.face_id = p.preferred_face
    ELSE NOT list_contains(t.excluded, c.face_id) END) q WHERE rn = 1)
SELECT p.job_id, p.event_id, coalesce(h.face_id, CASE WHEN p.allow_fallback THEN g.face_id END, '') AS capture_face, h.frame_ts AS capture_ts,
  CASE WHEN h.face_id IS NOT NULL THEN 'frame' WHEN p.allow_fallback AND g.face_id IS NOT NULL THEN 'cluster' ELSE 'none' END AS capture_source
FROM {pref} p LEFT JOIN hit h ON h.job_id = p.job_id AND h.event_id = p.event_id LEFT JOIN pic g ON g.job_id = p.job_id AND g.face_id = p.preferred_face"""


@query("a7_choose_capture", TRIES + ",\n" + PICTURES + ", pf AS (SELECT *, lip_score <= 0 AS allow_fallback FROM pref)" + chosen_sql("pf", "tries"))
def _(t):
    rows = assign.choose_capture(wanted(t), captures(t), pictures(t))
    return rows.select("job_id", "event_id", "capture_face", "capture_ts", "capture_source")


@query("a9_face_labels", A8 + " SELECT w.job_id, w.face_id, e.name FROM won w JOIN event_v e ON e.job_id = w.job_id AND e.event_id = w.event_id")
def _(t):
    order = events(t)
    return assign.face_labels(order, assign.assign_faces(order, ranked(t), captures(t)))


@query("a10_detection_records", A8 + """
SELECT e.job_id, e.event_id, e.name, coalesce(w.face_id, '') AS face_id, round(coalesce(w.lip_score, 0), 6) AS lip_score, e.source_video AS clip_label,
  'name_intro_thumbnails/' || e.name || '_' || CAST(trunc(e.ts_s) AS BIGINT) || '_' || e.source_video || '.jpg' AS thumbnail_file, '' AS location
FROM event_v e LEFT JOIN won w ON w.job_id = e.job_id AND w.event_id = e.event_id""")
def _(t):
    order = events(t).drop("face_id", "lip_score").withColumns({"transcript": F.lit("and so on"), "context_transcript": F.lit("")})
    rows = assign.detection_records(order, assign.assign_faces(order, ranked(t), captures(t)))
    return rows.select(
        "job_id", "event_id", "name", "face_id", F.round("lip_score", 6).alias("lip_score"), "clip_label", "thumbnail_file", "location"
    )


# Stored pictures: one per event, and the cluster pictures of three faces.
THUMBS = """thumb AS (SELECT job_id, 'intro/' || event_id || '.jpg' AS path, (event_id * 37) % 1300 AS width, (event_id * 53) % 800 AS height,
    (event_id * 7) % 60 + 0.0E0 AS brightness FROM event_v
  UNION ALL SELECT DISTINCT job_id, 'face_thumbnails/' || cluster_id || '.jpg', 200, 200, 90.0E0 FROM obs_v WHERE cluster_id IN ('face_0', 'face_1', 'face_2')),
usable AS (SELECT job_id, path FROM thumb WHERE NOT (width > 900 AND height > 500) AND brightness >= 20 AND greatest(width, height) >= 80)"""


def thumbnails(t):
    own = t.event.selectExpr(
        "job_id", "concat('intro/', event_id, '.jpg') AS path", "(event_id * 37) % 1300 AS width", "(event_id * 53) % 800 AS height",
        "CAST((event_id * 7) % 60 AS DOUBLE) AS brightness",
    )
    return own.unionByName(pictures(t).selectExpr(
        "job_id", "concat('face_thumbnails/', face_id, '.jpg') AS path", "200L AS width", "200L AS height", "90D AS brightness"
    ))


def with_files(t):
    return t.event.withColumn("thumbnail_file", F.concat(F.lit("intro/"), F.col("event_id"), F.lit(".jpg")))


@query("a11_display_thumbnails", with_views("obs_v", "event_v") + ",\n" + THUMBS + """
SELECT e.job_id, e.event_id, CASE WHEN u.path IS NOT NULL THEN u.path WHEN c.path IS NOT NULL THEN c.path ELSE 'intro/' || e.event_id || '.jpg' END AS display_path
FROM event_v e LEFT JOIN usable u ON u.job_id = e.job_id AND u.path = 'intro/' || e.event_id || '.jpg'
LEFT JOIN thumb c ON c.job_id = e.job_id AND e.face_id <> '' AND c.path = 'face_thumbnails/' || e.face_id || '.jpg'""")
def _(t):
    return assign.display_thumbnails(with_files(t), thumbnails(t)).select("job_id", "event_id", "display_path")


@query("a12_refresh_thumbnails", BASE + CAPTURES + ",\n" + PICTURES + ",\n" + THUMBS + """,
pf AS (SELECT e.job_id, e.event_id, e.face_id AS preferred_face, e.lip_score <= 0 OR e.face_id <> 'face_0' AS allow_fallback FROM event_v e
  WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.job_id = e.job_id AND u.path = 'intro/' || e.event_id || '.jpg')),
tries AS (SELECT job_id, event_id, 0 AS attempt, CAST([] AS VARCHAR[]) AS excluded FROM pf)""" + chosen_sql("pf", "tries"))
def _(t):
    rows = assign.refresh_thumbnails(with_files(t), thumbnails(t), captures(t), pictures(t))
    return rows.select("job_id", "event_id", "capture_face", "capture_ts", "capture_source")
