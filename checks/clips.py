"""Introduction clip planning queries: I1-I12."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import with_views
from rollcall.operators import clips
from rollcall.operators.clips import SEARCH_OFFSETS

OBS = with_views("obs_v")
SECONDS = """sec AS (SELECT job_id, round_even(ts_s, 0) AS second, count(DISTINCT cluster_id) AS faces FROM obs_v WHERE cluster_id <> '' GROUP BY ALL),
wide AS (SELECT job_id, second AS wide_second, faces AS wide_faces FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY faces DESC, second DESC) AS rn
  FROM sec) q WHERE rn = 1)"""


def window_cte(name: str, source: str, start: str, end: str) -> str:
    """Distinct faces per second of each event's closed window, from the observations themselves."""
    return f"""{name} AS (SELECT e.job_id, e.event_id, round_even(o.ts_s, 0) AS second, count(DISTINCT o.cluster_id) AS faces FROM {source} e
  JOIN obs_v o ON o.job_id = e.job_id AND o.ts_s >= {start} AND o.ts_s <= {end} WHERE o.cluster_id <> '' GROUP BY ALL)"""


BASE = with_views("obs_v", "event_v", "frame_v") + ",\n" + SECONDS
# Cluster counts per job: 5, 3 or unknown (0).
COUNTS = "cc AS (SELECT job_id, CASE CAST(substr(job_id, 5) AS INT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 5 END AS clusters FROM (SELECT DISTINCT job_id FROM obs_v) q)"
I4 = BASE + ",\n" + COUNTS + ",\n" + window_cte("win", "event_v", "greatest(e.ts_s - 10, 0)", "e.ts_s + 150") + """,
pk AS (SELECT job_id, event_id, max(faces) AS peak, max(second) FILTER (faces = m) AS last_peak, min(second) FILTER (faces = m) AS first_peak FROM (
  SELECT *, max(faces) OVER (PARTITION BY job_id, event_id) AS m FROM win) q GROUP BY ALL),
fullc AS (SELECT w.job_id, w.event_id, min(w.second) AS full_second FROM win w JOIN cc ON cc.job_id = w.job_id WHERE cc.clusters > 0 AND w.faces >= cc.clusters GROUP BY ALL),
i4 AS (SELECT e.*, greatest(e.ts_s - 4, 0) AS clip_start, least(48, greatest(24, greatest(e.ts_s + 18,
    coalesce(CASE WHEN cc.clusters > 0 AND f.full_second IS NOT NULL THEN f.full_second WHEN cc.clusters = 0 THEN p.first_peak ELSE p.last_peak END, 0) + 12)
    - greatest(e.ts_s - 4, 0))) AS clip_length
  FROM event_v e LEFT JOIN cc ON cc.job_id = e.job_id LEFT JOIN pk p ON p.job_id = e.job_id AND p.event_id = e.event_id
  LEFT JOIN fullc f ON f.job_id = e.job_id AND f.event_id = e.event_id)"""


def cluster_counts(t):
    day = F.substring("job_id", 5, 2).cast("int") % 3
    return t.obs.select("job_id").distinct().withColumn("clusters", F.when(day == 0, 0).when(day == 1, 3).otherwise(5))


def planned(t):
    return clips.clip_windows(t.event, clips.presence(t.obs), cluster_counts(t))


@query("i1_presence_per_second", BASE + " SELECT job_id, second, faces FROM sec")
def _(t):
    return clips.presence_counts(clips.presence(t.obs))


@query("i1_presence_in_window", BASE + ",\n" + window_cte("win", "event_v", "e.ts_s - 3.2", "e.ts_s + 7.4") + " SELECT * FROM win")
def _(t):
    at = F.col("timestamp")
    return clips.presence_in(clips.presence(t.obs), t.event, at - 3.2, at + 7.4)


@query("i2_peak_window", BASE + ",\n" + window_cte("win", "event_v", "e.ts_s - 3.2", "e.ts_s + 7.4") + """ SELECT job_id, event_id, second AS peak_second,
  faces AS peak_faces FROM (SELECT *, row_number() OVER (PARTITION BY job_id, event_id ORDER BY faces DESC, second DESC) AS rn FROM win) q WHERE rn = 1""")
def _(t):
    at = F.col("timestamp")
    return clips.peak_in(clips.presence_in(clips.presence(t.obs), t.event, at - 3.2, at + 7.4))


@query("i3_global_wide_shot", BASE + " SELECT * FROM wide")
def _(t):
    return clips.global_wide_shot(clips.presence_counts(clips.presence(t.obs)))


@query("i4_clip_windows", I4 + " SELECT job_id, event_id, round(clip_start, 6) AS clip_start, round(clip_length, 6) AS clip_length FROM i4")
def _(t):
    return planned(t).select("job_id", "event_id", F.round("clip_start", 6).alias("clip_start"), F.round("clip_length", 6).alias("clip_length"))


I5 = I4 + ",\n" + window_cte("span", "i4", "e.clip_start", "e.clip_start + e.clip_length") + """,
i5 AS (SELECT i.*, coalesce(m.peak, 0) AS peak FROM i4 i LEFT JOIN (SELECT job_id, event_id, max(faces) AS peak FROM span GROUP BY ALL) m
  ON m.job_id = i.job_id AND m.event_id = i.event_id)"""


def peaked(t):
    return clips.primary_peaks(planned(t), clips.presence(t.obs), "clip_start", "clip_length", "peak")


@query("i5_primary_peaks", I5 + " SELECT job_id, event_id, peak FROM i5")
def _(t):
    return peaked(t).select("job_id", "event_id", "peak")


I6 = I5 + """,
i6 AS (SELECT i.*, w.wide_faces > 0 AND w.wide_faces > i.peak AND w.wide_second > i.clip_start + i.clip_length - 5 AS tail, w.wide_second, w.wide_faces
  FROM i5 i LEFT JOIN wide w ON w.job_id = i.job_id)"""


@query("i6_wide_tail", I6 + """ SELECT job_id, event_id, tail AS includes_full_cast, CASE WHEN tail THEN greatest(peak, wide_faces) ELSE peak END AS faces_visible FROM i6""")
def _(t):
    wide = clips.global_wide_shot(clips.presence_counts(clips.presence(t.obs)))
    rows = clips.add_wide_tail(peaked(t), wide, "clip_start", "clip_length", "peak")
    return rows.select("job_id", "event_id", "includes_full_cast", "faces_visible")


@query("i11_wide_tail_plan", I6 + " SELECT job_id, event_id, greatest(wide_second - 3, 0) AS tail_start, 14.0E0 AS tail_length FROM i6 WHERE tail")
def _(t):
    wide = clips.global_wide_shot(clips.presence_counts(clips.presence(t.obs)))
    rows = clips.add_wide_tail(peaked(t), wide, "clip_start", "clip_length", "peak")
    return rows.filter("includes_full_cast").select("job_id", "event_id", "tail_start", "tail_length")


# Brightness per whole second; seconds 20 to 44 of every third job are dark.
TIMELINE = """tl AS (SELECT f.job_id, c.source_video, f.second_s AS second, CASE WHEN CAST(substr(f.job_id, 5) AS INT) % 3 = 0 AND f.second_s BETWEEN 20 AND 44
  THEN 0 ELSE f.brightness END AS brightness FROM frame_v f JOIN (SELECT DISTINCT job_id, source_video FROM obs_v) c ON c.job_id = f.job_id)"""
STAGES = ", ".join(
    f"({i}, {SEARCH_OFFSETS[i - 1] if i else 0.0}::DOUBLE, {o}::DOUBLE)" for i, o in enumerate(SEARCH_OFFSETS)
)
VISIBLE = TIMELINE + f""",
st AS (SELECT * FROM (VALUES {STAGES}) v(stage, lo, hi)),
seen AS (SELECT e.job_id, e.event_id, s.stage, f.second, row_number() OVER (PARTITION BY e.job_id, e.event_id ORDER BY s.stage, f.second) AS rn
  FROM event_v e CROSS JOIN st s JOIN tl f ON f.job_id = e.job_id AND f.source_video = e.source_video AND f.brightness >= 12
  AND f.second BETWEEN trunc(greatest(e.ts_s + s.lo, 0)) AND trunc(e.ts_s + s.hi)),
vis AS (SELECT e.*, v.second AS visible_s FROM event_v e LEFT JOIN seen v ON v.job_id = e.job_id AND v.event_id = e.event_id AND v.rn = 1)"""


def timeline(t):
    both = t.obs.select("job_id", "source_video").distinct()
    dark = (F.substring("job_id", 5, 2).cast("int") % 3 == 0) & F.col("second_s").between(20, 44)
    return t.frame.join(both, "job_id").select(
        "job_id", "source_video", F.col("second_s").alias("second"), F.when(dark, 0.0).otherwise(F.col("brightness")).alias("brightness")
    )


@query("i7_first_visible", BASE + ",\n" + VISIBLE + " SELECT job_id, event_id, visible_s FROM vis")
def _(t):
    return clips.first_visible(t.event, timeline(t)).select("job_id", "event_id", "visible_s")


REALIGN = "coalesce(visible_s > ts_s + 8, FALSE) AND NOT (face_id <> '' AND lip_score > 0)"


def realigned(t):
    rows = clips.first_visible(t.event, timeline(t))
    flag = clips.needs_realign(F.col("visible_s"), F.col("timestamp"), F.col("face_id"), F.col("lip_score"))
    return rows.withColumn("audio_realigned", flag)


@query("i8_needs_realign", BASE + ",\n" + VISIBLE + f" SELECT job_id, event_id, {REALIGN} AS audio_realigned FROM vis")
def _(t):
    return realigned(t).select("job_id", "event_id", "audio_realigned")


@query("i9_realigned_plan", BASE + ",\n" + VISIBLE + f""" SELECT job_id, event_id, greatest(ts_s - 2, 0) AS audio_start,
  greatest(visible_s - 3, 0) AS video_start, 14.0E0 AS realigned_length FROM vis WHERE {REALIGN}""")
def _(t):
    rows = clips.realigned_plan(realigned(t)).filter("audio_realigned")
    return rows.select("job_id", "event_id", "audio_start", "video_start", "realigned_length")


@query("i10_clamp_to_media", """SELECT event_id, CASE WHEN dur > 0 THEN least(s, greatest(dur - 1, 0)) ELSE s END AS start_s,
  CASE WHEN dur > 0 THEN least(len, greatest(dur - least(s, greatest(dur - 1, 0)), 1)) ELSE len END AS length_s
FROM (SELECT event_id, value AS s, (user_id % 50) + 0.0E0 AS len, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 90 END + 0.0E0 AS dur FROM events) q""")
def _(t):
    rows = t.table("events").selectExpr(
        "event_id", "value AS s", "CAST(user_id % 50 AS DOUBLE) AS len",
        "CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 90 END AS DOUBLE) AS dur",
    )
    start, length = clips.clamp_to_media(F.col("s"), F.col("len"), F.col("dur"))
    return rows.select("event_id", start.alias("start_s"), length.alias("length_s"))


# Known clips: clip_0 everywhere (main), clip_1 in even jobs; jobs 7 and 14 have no clip at all.
KNOWN = """known AS (SELECT job_id, source_video, source_video = 'clip_0' AS is_main, 60.0E0 + d AS duration_s FROM (
  SELECT DISTINCT job_id, source_video, CAST(substr(job_id, 5) AS INT) AS d FROM obs_v) q WHERE d NOT IN (7, 14) AND (source_video = 'clip_0' OR d % 2 = 0))"""


@query("i12_clip_records", I4.replace("FROM event_v e LEFT JOIN cc", "FROM ev e LEFT JOIN cc").replace(
    COUNTS, COUNTS + ",\n" + KNOWN + """,
ev AS (SELECT e.* EXCLUDE (source_video), CASE WHEN k.job_id IS NOT NULL THEN e.source_video ELSE m.source_video END AS source_video,
    coalesce(k.duration_s, m.duration_s) AS duration_s, e.source_video AS clip_label FROM event_v e LEFT JOIN known k ON k.job_id = e.job_id AND k.source_video = e.source_video
    LEFT JOIN known m ON m.job_id = e.job_id AND m.is_main)""") + ",\n" + VISIBLE.replace("FROM event_v e CROSS JOIN st", "FROM i4 e CROSS JOIN st").replace(
    "FROM event_v e LEFT JOIN seen", "FROM i4 e LEFT JOIN seen") + f""",
pl AS (SELECT *, {REALIGN} AS realign FROM vis),
sp AS (SELECT *, CASE WHEN realign THEN greatest(visible_s - 3, 0) ELSE clip_start END AS s, CASE WHEN realign THEN 30 ELSE clip_length END AS len FROM pl),
""" + window_cte("span", "sp", "e.s", "e.s + e.len") + """,
fin AS (SELECT p.*, coalesce(m.peak, 0) AS peak, w.wide_second, w.wide_faces, w.wide_faces > coalesce(m.peak, 0) AND w.wide_second > p.s + p.len - 5 AS tail
  FROM sp p LEFT JOIN (SELECT job_id, event_id, max(faces) AS peak FROM span GROUP BY ALL) m ON m.job_id = p.job_id AND m.event_id = p.event_id
  LEFT JOIN wide w ON w.job_id = p.job_id)
SELECT job_id, event_id, CASE WHEN source_video IS NULL THEN '' ELSE 'intro_clips/' || name || '_' || CAST(trunc(ts_s) AS BIGINT) || '_' || clip_label || '.mp4' END AS intro_clip_file,
  CASE WHEN source_video IS NOT NULL THEN round(clip_start, 2) END AS intro_clip_start, CASE WHEN source_video IS NOT NULL THEN round(clip_length, 2) END AS intro_clip_duration,
  CASE WHEN source_video IS NULL THEN 0 WHEN tail THEN greatest(peak, wide_faces) ELSE peak END AS intro_clip_faces_visible,
  source_video IS NOT NULL AND tail AS intro_clip_includes_full_cast, source_video IS NOT NULL AND realign AS intro_clip_audio_realigned,
  round(CASE WHEN source_video IS NOT NULL THEN least(s, greatest(duration_s - 1, 0)) END, 6) AS encode_start,
  round(CASE WHEN source_video IS NOT NULL THEN least(CASE WHEN realign THEN 14 ELSE clip_length END, greatest(duration_s - least(s, greatest(duration_s - 1, 0)), 1)) END, 6) AS encode_length
FROM fin""")
def _(t):
    day = F.substring("job_id", 5, 2).cast("int")
    known = t.obs.select("job_id", "source_video").distinct().withColumn("d", day).filter(
        "d NOT IN (7, 14) AND (source_video = 'clip_0' OR d % 2 = 0)"
    ).selectExpr("job_id", "source_video", "source_video = 'clip_0' AS is_main", "60D + d AS duration_s")
    events = t.event.withColumn("clip_label", F.col("source_video"))
    rows = clips.plan_intro_clips(events, t.obs, timeline(t), known, cluster_counts(t))
    return rows.select(
        "job_id", "event_id", "intro_clip_file", "intro_clip_start", "intro_clip_duration", "intro_clip_faces_visible",
        "intro_clip_includes_full_cast", "intro_clip_audio_realigned",
        F.round("encode_start", 6).alias("encode_start"), F.round("encode_length", 6).alias("encode_length"),
    )
