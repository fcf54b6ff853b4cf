"""Frame sampling, face rows and file-name queries: P1-P13, F2-F5, S1, S2, S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import with_views
from rollcall.functions import scalars, vectors
from rollcall.operators import sampling
from rollcall.sources import media

FRAMES = with_views("frame_v")
CLIP_ROWS = """clip_v AS (SELECT job_id, source_video, source_video = 'clip_0' AS is_main, 25.0E0 AS native_fps
  FROM (SELECT DISTINCT job_id, source_video FROM obs_v) q)"""


@query("p1_stride_sampling", FRAMES + """ SELECT job_id, frame_idx, round(frame_idx / native_fps, 6) AS ts_s FROM frame_v
  WHERE frame_idx % greatest(CAST(round_even(native_fps / 2.0, 0) AS BIGINT), 1) = 0 AND frame_idx <= CAST(trunc(8.0 * native_fps) AS BIGINT)""")
def _(t):
    return sampling.sample_frames(t.frame, 2.0, F.lit(8.0)).select(
        "job_id", "frame_idx", F.round("timestamp", 6).alias("ts_s")
    )


@query("p2_intro_pass", FRAMES + """ SELECT job_id, frame_idx, 1 AS pass FROM frame_v
  WHERE frame_idx % CAST(round_even(native_fps / 1.0, 0) AS BIGINT) = 0
UNION ALL SELECT job_id, frame_idx, 2 FROM frame_v
  WHERE frame_idx % CAST(round_even(native_fps / 2.5, 0) AS BIGINT) = 0 AND frame_idx <= 180 * native_fps""")
def _(t):
    return sampling.sample_with_intro_pass(t.frame, 1.0).select("job_id", "frame_idx", "pass")


@query("p3_duration_limits", with_views("obs_v", "frame_v") + ",\n" + CLIP_ROWS + """,
f AS (SELECT f.job_id, c.source_video, f.frame_idx, CASE WHEN c.is_main THEN 6.0 ELSE 3.5 END AS lim FROM frame_v f JOIN clip_v c ON c.job_id = f.job_id)
SELECT job_id, source_video, frame_idx, 1 AS pass FROM f WHERE frame_idx % 12 = 0 AND frame_idx <= trunc(lim * 25)
UNION ALL SELECT job_id, source_video, frame_idx, 2 FROM f WHERE frame_idx % 10 = 0 AND frame_idx <= trunc(lim * 25)""")
def _(t):
    clips = _clips(t)
    frames = t.frame.drop("native_fps").join(clips.select("job_id", "source_video"), "job_id")
    return sampling.frames_to_analyse(frames, clips, 2.0, max_s=6.0, extra_max_s=3.5).select(
        "job_id", "source_video", "frame_idx", "pass"
    )


def _clips(t):
    return t.obs.select("job_id", "source_video").distinct().withColumns({
        "is_main": F.col("source_video") == "clip_0", "native_fps": F.lit(25.0)
    })


@query("p3_fast_mode", with_views("obs_v") + ",\n" + CLIP_ROWS + " SELECT job_id, source_video, 600.0E0 AS limit_s FROM clip_v")
def _(t):
    return sampling.duration_limits(_clips(t), fast=True).select("job_id", "source_video", "limit_s")


@query("p4_range_sampling", FRAMES + """ SELECT job_id, frame_idx, round(frame_idx / native_fps, 6) AS ts_s FROM frame_v
  WHERE frame_idx BETWEEN 52 AND 227 AND (frame_idx - 52) % 3 = 0""")
def _(t):
    return sampling.sample_range(t.frame, F.lit(2.1), F.lit(9.1)).select(
        "job_id", "frame_idx", F.round("timestamp", 6).alias("ts_s")
    )


# Landmarks: 21 points cut from each 64-value vector.
POINTS = "transform(sequence(0, 20), i -> named_struct('x', embedding[3 * i], 'y', embedding[3 * i + 1], 'z', embedding[3 * i + 2]))"


def _landmarks(t):
    return t.table("embeddings").select(
        F.concat(F.lit("job_"), F.col("label").cast("string")).alias("job_id"), F.lit("clip_0").alias("source_video"),
        F.col("vec_id").cast("double").alias("timestamp"), F.lit(1).alias("pass"), F.lit(0).alias("face_idx"),
        F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.expr(POINTS).alias("points"), "vec_id",
    )


def _faces(t):
    return sampling.observations_from_landmarks(_landmarks(t)).withColumn("vec_id", F.col("timestamp").cast("long"))


@query("p5_landmark_embedding", """
SELECT vec_id, pos, value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value,
  generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) q WHERE pos < 63""")
def _(t):
    return _faces(t).select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query("p6_lip_openness", "SELECT vec_id, round(CAST(abs(embedding[41] - embedding[44]) AS DOUBLE), 6) AS lip FROM embeddings")
def _(t):
    return _faces(t).select("vec_id", F.round("lip_openness", 6).alias("lip"))


def _axis(first: int, size: int) -> str:
    return f"[CAST(embedding[{first} + 3 * i] AS DOUBLE) * {size} for i in range(0, 21)]"


@query("p7_bounding_box", f"""
SELECT vec_id, greatest(CAST(trunc(list_min({_axis(1, 1920)})) AS INTEGER) - 10, 0) AS x1,
  greatest(CAST(trunc(list_min({_axis(2, 1080)})) AS INTEGER) - 10, 0) AS y1,
  least(CAST(trunc(list_max({_axis(1, 1920)})) AS INTEGER) + 10, 1919) AS x2,
  least(CAST(trunc(list_max({_axis(2, 1080)})) AS INTEGER) + 10, 1079) AS y2 FROM embeddings""")
def _(t):
    return _faces(t).select("vec_id", "bbox.*")


FEATURE = """[CAST(e AS DOUBLE) * 0.35 / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8) for e in embedding]
  || [(x1 + x2) / 2.0 / 1920 * 2.5, (y1 + y2) / 2.0 / 1080 * 2.5, (x2 - x1) / 1920.0 * 2.5]"""


def frame_size(t):
    return t.obs.select("job_id").distinct().select(
        "job_id", F.lit(1920.0).alias("frame_width"), F.lit(1080.0).alias("frame_height")
    )


@query("p8_cluster_feature", with_views("obs_v") + f""", f AS (SELECT job_id, obs_id, {FEATURE} AS f FROM obs_v)
SELECT job_id, obs_id, round(list_sum([f[i] * i for i in range(1, 65)]), 6) AS appearance,
  round(f[65], 6) AS cx, round(f[66], 6) AS cy, round(f[67], 6) AS width FROM f""")
def _(t):
    weighted = F.transform(F.slice("feature", 1, 64), lambda v, i: v * (i + 1))
    at = lambda i: F.round(F.element_at("feature", F.lit(i)), 6)
    return sampling.add_features(t.obs, frame_size(t)).select(
        "job_id", "obs_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), 6).alias("appearance"),
        at(65).alias("cx"), at(66).alias("cy"), at(67).alias("width"),
    )


IMAGE = "(obs_id * 37) % 1300 AS width, (obs_id * 53) % 800 AS height, (obs_id * 7) % 60 + lip_openness AS brightness"


@query("p9_usable_thumbnail", with_views("obs_v") + f""" SELECT job_id, obs_id,
  NOT (width > 900 AND height > 500) AND brightness >= 20 AND greatest(width, height) >= 80 AS usable
FROM (SELECT job_id, obs_id, {IMAGE} FROM obs_v) q""")
def _(t):
    images = t.obs.selectExpr("job_id", "obs_id", *IMAGE.replace(", (", "|(").split("|"))
    return images.select(
        "job_id", "obs_id", sampling.usable_thumbnail(F.col("width"), F.col("height"), F.col("brightness")).alias("usable")
    )


@query("p10_bright_frames", FRAMES + " SELECT job_id, frame_idx FROM frame_v WHERE brightness >= 12")
def _(t):
    return sampling.bright_frames(t.frame).select("job_id", "frame_idx")


UPLOAD = """p_name || CASE p_partkey % 8 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' WHEN 3 THEN '.Webm'
  WHEN 4 THEN '' WHEN 5 THEN '.mp4.zip' WHEN 6 THEN '.mkv' ELSE '.avi' END"""


@query("p11_upload_suffixes", f"""SELECT p_partkey, suffix IN ('.mp4', '.mov', '.m4v', '.mkv', '.avi', '.webm') AS accepted,
  CASE WHEN suffix IN ('.mp4', '.mov', '.m4v', '.mkv', '.avi', '.webm') THEN NULL ELSE 'Unsupported file type: '
    || CASE WHEN suffix = '' THEN '(none)' ELSE suffix END || '. Upload MP4, MOV, or similar video files.' END AS reason
FROM (SELECT p_partkey, lower(regexp_extract({UPLOAD}, '^.+(\\.[^.]+)$', 1)) AS suffix FROM part) q""")
def _(t):
    uploads = t.table("part").select("p_partkey", F.expr(UPLOAD).alias("upload_name"))
    accepted, rejected = sampling.split_uploads(uploads)
    return accepted.select("p_partkey", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("p_partkey", F.lit(False).alias("accepted"), "reason")
    )


@query("p12_frame_sizes", """SELECT 'job_' || c_custkey AS job_id,
  CASE WHEN c_custkey % 3 = 0 THEN 1920.0 WHEN c_custkey % 3 = 1 THEN 1920.0 ELSE c_custkey * 2.0 END AS frame_width,
  CASE WHEN c_custkey % 4 = 0 THEN 1080.0 ELSE c_custkey * 1.0 END AS frame_height FROM customer""")
def _(t):
    clips = t.table("customer").selectExpr(
        "concat('job_', c_custkey) AS job_id", "true AS is_main",
        "CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN NULL ELSE c_custkey * 2 END AS width",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS height",
    )
    return sampling.frame_sizes(clips)


@query("p13_face_score", with_views("obs_v") + """ SELECT job_id, obs_id,
  round(lip_openness * 1000.0 + CAST((x2 - x1) AS DOUBLE) * (y2 - y1), 6) AS score FROM obs_v""")
def _(t):
    return t.obs.select("job_id", "obs_id", F.round(vectors.face_score(F.col("bbox"), F.col("lip_openness")), 6).alias("score"))


@query("f2_short_timecode", """SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60)
  ELSE printf('%d:%02d', s // 60, s % 60) END AS tc
FROM (SELECT event_id, greatest(CAST(round_even(value * 37 - 50, 0) AS BIGINT), 0) AS s FROM events) q""")
def _(t):
    return t.table("events").select("event_id", scalars.short_timecode(F.col("value") * 37 - 50).alias("tc"))


def stem_sql(text: str, default: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({text}, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), '{default}')"


@query("f3_safe_stem", f"SELECT doc_id, {stem_sql('text', 'intro')} AS stem FROM documents")
def _(t):
    return t.table("documents").select("doc_id", scalars.safe_stem(F.col("text"), "intro").alias("stem"))


@query("f4_artifact_name", with_views("event_v") + f""" SELECT job_id, event_id, {stem_sql('name', 'name')} || '_'
  || CAST(trunc(ts_s) AS BIGINT) || '_' || {stem_sql('source_video', 'clip')} || '.jpg' AS file_name FROM event_v""")
def _(t):
    return t.event.select(
        "job_id", "event_id",
        scalars.artifact_name(F.col("name"), F.col("timestamp"), F.col("source_video"), ".jpg", "name").alias("file_name"),
    )


@query("f5_clip_label", f"""SELECT p_partkey, CASE WHEN regexp_matches(base, '^.+\\.[^.]+$') THEN regexp_extract(base, '^(.+)\\.[^.]+$', 1)
  ELSE base END AS label FROM (SELECT p_partkey, {UPLOAD} AS base FROM part) q""")
def _(t):
    path = F.concat(F.lit("/footage/day one/"), F.expr(UPLOAD))
    return t.table("part").select("p_partkey", scalars.clip_label(path).alias("label"))


PATHS = f"'/footage/' || p_brand || '/' || {UPLOAD}"


@query("s1_clip_discovery", f"""SELECT path, row_number() OVER (ORDER BY path) - 1 AS clip_idx FROM (SELECT DISTINCT {PATHS} AS path FROM part
  WHERE regexp_matches(lower({UPLOAD}), '^.+\\.(mp4|mov|m4v|mkv|avi|webm)$')) q""")
def _(t):
    listing = t.table("part").select(F.expr(PATHS).alias("path")).distinct()
    return media.number_clips(media.video_files(listing.withColumn("job_id", F.lit("all")))).select("path", "clip_idx")


@query("s2_clip_manifest", f"""
SELECT job_id, path AS source_video, is_main, row_number() OVER (PARTITION BY job_id ORDER BY NOT is_main, ord) - 1 AS clip_idx
FROM (SELECT p_brand AS job_id, {PATHS} AS path, min(p_partkey) AS ord, bool_or(p_partkey = first_key) AS is_main
  FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS first_key FROM part) q GROUP BY 1, 2) q""")
def _(t):
    listed = t.table("part").select(F.col("p_brand").alias("job_id"), F.expr(PATHS).alias("source_video"), F.col("p_partkey").alias("ord"))
    main = listed.groupBy("job_id").agg(F.min_by("source_video", "ord").alias("source_video"))
    return media.clip_manifest(main, listed)


@query("s3_manifest_fallback", """
WITH j AS (SELECT c_custkey AS k, 'job_' || c_custkey AS job_id FROM customer)
SELECT job_id, 0 AS clip_idx, CASE WHEN k % 3 = 0 THEN 'listed_a' WHEN k % 3 = 1 THEN 'sampled' ELSE 'main' END AS source_video FROM j
UNION ALL SELECT job_id, 1, 'listed_b' FROM j WHERE k % 3 = 0""")
def _(t):
    jobs = t.table("customer").selectExpr("c_custkey AS k", "concat('job_', c_custkey) AS job_id")
    return media.clip_paths(
        jobs.selectExpr("job_id", "'main' AS main_video"),
        jobs.filter("k % 3 = 0").selectExpr("job_id", "array('listed_a', 'listed_b') AS all_clips"),
        jobs.selectExpr("job_id", "CASE WHEN k % 3 = 1 THEN array('sampled') ELSE array() END AS sampled_videos"),
    )
