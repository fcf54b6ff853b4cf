"""Clip planning, timecodes, frame sampling and pictures, by worked examples."""

import math
import random

from pyspark.sql import functions as F

from rollcall.functions import scalars
from rollcall.operators import clips, correlate, sampling, screengrab

OBS = "job_id string, obs_id long, timestamp double, cluster_id string"


def _events(spark, rows):
    return spark.createDataFrame([("j", i, t) for i, t in enumerate(rows)], "job_id string, event_id long, timestamp double")


def test_presence_rounds_half_even(spark):
    obs = spark.createDataFrame([("j", 0, 0.5, "face_0"), ("j", 1, 1.5, "face_0"), ("j", 2, 1.6, "")], OBS)
    got = {r.second: r.faces for r in clips.presence_counts(clips.presence(obs)).collect()}
    assert got == {0.0: 1, 2.0: 1}


def test_wide_shot_prefers_latest(spark):
    rows = [("j", i, t, f"face_{f}") for i, (t, f) in enumerate([(5, 0), (5, 1), (9, 0), (9, 2), (11, 1)])]
    obs = spark.createDataFrame([(j, i, float(t), c) for j, i, t, c in rows], OBS)
    got = clips.global_wide_shot(clips.presence_counts(clips.presence(obs))).first()
    assert (got.wide_second, got.wide_faces) == (9.0, 2)


def _loop_window(t, obs, clusters):
    """The clip window rule, second by second."""
    low, high = max(t - 10, 0.0), t + 150
    seconds = {}
    for ts, face in obs:
        if face and low <= ts <= high:
            seconds.setdefault(int(round(ts)), set()).add(face)
    counts = sorted((float(s), len(f)) for s, f in seconds.items())
    peak = max(counts, key=lambda c: (c[1], c[0]), default=(0.0, 0))
    target, best = clusters or peak[1], peak[0]
    reached = [s for s, n in counts if target and n >= target]
    if reached:
        best = reached[0]
    start = max(t - 4, 0.0)
    return start, min(48.0, max(24.0, max(t + 18, best + 12) - start))


def test_clip_window_matches_rule(spark):
    rng = random.Random(4)
    obs = [(rng.randrange(0, 600) / 2, rng.choice(["", "face_0", "face_1", "face_2", "face_3"])) for _ in range(400)]
    times = [0.35, 3.2, 100.0, 140.75, 299.0, 500.0] + [rng.uniform(0, 320) for _ in range(20)]
    table = clips.presence(spark.createDataFrame([("j", i, t, f) for i, (t, f) in enumerate(obs)], OBS))
    for clusters in (0, 2, 4, 9):
        counts = spark.createDataFrame([("j", clusters)], "job_id string, clusters int")
        got = clips.clip_windows(_events(spark, times), table, counts).orderBy("event_id").collect()
        for row, t in zip(got, times):
            start, length = _loop_window(t, obs, clusters)
            assert abs(row.clip_start - start) < 1e-9 and abs(row.clip_length - length) < 1e-9
            assert 24.0 <= row.clip_length <= 48.0


def test_clip_window_without_observations(spark):
    empty = clips.presence(spark.createDataFrame([], OBS))
    counts = spark.createDataFrame([("j", 0)], "job_id string, clusters int")
    row = clips.clip_windows(_events(spark, [100.0]), empty, counts).first()
    assert (row.clip_start, row.clip_length) == (96.0, 24.0)


def test_realign(spark):
    frames = spark.createDataFrame(
        [("j", "m", float(s), 0.0 if s < 120 else 50.0) for s in range(90, 140)], "job_id string, source_video string, second double, brightness double"
    )
    events = spark.createDataFrame([("j", 0, "m", 100.0, "", 0.0), ("j", 1, "m", 100.0, "face_1", 4.0)],
                                   "job_id string, event_id long, source_video string, timestamp double, face_id string, lip_score double")
    seen = clips.first_visible(events, frames)
    flag = clips.needs_realign(F.col("visible_s"), F.col("timestamp"), F.col("face_id"), F.col("lip_score"))
    got = clips.realigned_plan(seen.withColumn("audio_realigned", flag)).orderBy("event_id").collect()
    assert (got[0].visible_s, got[0].audio_realigned, got[0].audio_start, got[0].video_start) == (120.0, True, 98.0, 117.0)
    assert not got[1].audio_realigned and got[1].audio_start is None


def test_timecodes_and_stems(spark):
    df = spark.createDataFrame([(3661.5, "..my clip (1)"), (59.9996, "/a/b.c.mp4"), (-0.4, "._")], "t double, p string")
    got = df.select(scalars.long_timecode(F.col("t")).alias("l"), scalars.short_timecode(F.col("t")).alias("s"),
                    scalars.safe_stem(F.col("p"), "intro").alias("stem"), scalars.clip_label(F.col("p")).alias("label")).collect()
    assert (got[0].l, got[0].s, got[0].stem) == ("01:01:01.500", "1:01:02", "my_clip_1")
    assert (got[1].l, got[1].s, got[1].label) == ("00:00:60.000", "1:00", "b.c")
    assert (got[2].s, got[2].stem) == ("0:00", "intro")


def test_sampling_defaults(spark):
    frames = spark.createDataFrame([("j", i, fps) for fps in (25.0, 0.0, None) for i in range(61)], "job_id string, frame_idx long, native_fps double")
    got = sampling.sample_frames(frames, 2.0, F.lit(1.0)).collect()
    by_fps = {}
    for r in got:
        by_fps.setdefault(r.native_fps, []).append(r.frame_idx)
    assert sorted(by_fps[25.0]) == [0, 12, 24]
    assert sorted(by_fps[0.0]) == sorted(by_fps[None]) == [0, 15, 30]


def test_speaker_evidence(spark):
    obs = spark.createDataFrame(
        [("j", 0, "m", 2.0, "face_1", 0.4), ("j", 1, "m", 2.0, "face_0", 0.4), ("j", 2, "m", 5.0, "face_0", 0.9), ("j", 3, "m", 7.0, "face_1", 0.9)],
        "job_id string, obs_id long, source_video string, timestamp double, cluster_id string, lip_openness double",
    )
    segments = spark.createDataFrame(
        [("j", 0, "s0", 0.0, 2.0), ("j", 1, "s0", 4.0, 5.0), ("j", 2, "s0", 6.0, 8.0), ("j", 3, "s1", 50.0, 60.0), ("j", 4, "s0", 70.0, 80.0)],
        "job_id string, seg_idx long, speaker_id string, start double, end double",
    )
    rows = correlate.correlate(obs, segments).collect()
    assert [(r.speaker_id, r.face_id, round(r.confidence, 4), r.evidence_segments) for r in rows] == [("s0", "face_1", 0.6667, 2)]
    thirds = correlate.lower_thirds(segments, correlate.correlate(obs, segments))
    labels = spark.createDataFrame([("j", "face_1", "")], "job_id string, face_id string, name string")
    got = correlate.apply_labels(thirds, labels).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.name) for r in got] == [(0, ""), (1, ""), (2, ""), (4, "")]
    clips = spark.createDataFrame([("j", "m", True), ("j", "x", False)], "job_id string, source_video string, is_main boolean")
    assert correlate.segment_observations(obs.withColumn("source_video", F.lit("x")), segments, main_only=clips).count() == 0
    assert correlate.segment_observations(obs.withColumn("source_video", F.lit("m")), segments, main_only=clips).count() > 0


def test_best_frame_without_faces(spark):
    obs = spark.createDataFrame([("j", 0, 7.0, "")], OBS)
    assert screengrab.best_frames(obs).first().timestamp == 0.0


def test_first_visible_stage_by_stage(spark):
    rng = random.Random(5)
    bright = {"m": [float(s) for s in range(0, 900) if rng.random() < 0.03], "n": [300.0]}
    frames = spark.createDataFrame([("j", v, s, 50.0) for v, at in bright.items() for s in at] + [("j", "m", 700.5, 50.0), ("j", "m", 5.0, 1.0), ("j", "n", None, 50.0)],
                                   "job_id string, source_video string, second double, brightness double")
    bright["m"].append(700.5)
    times = [0.0, 0.35, 0.5, 2.99, 127.9, 128.0, 128.49, 133.0, 383.75, 699.6, 1020.0, None, *[rng.uniform(0, 950) for _ in range(150)]]
    probes = [(v, t) for t in times for v in ("m", "n", "none", None)]
    rows = [("j", i, v, t) for i, (v, t) in enumerate(probes)]
    events = spark.createDataFrame(rows, "job_id string, event_id long, source_video string, timestamp double")
    found = clips.first_visible(events, frames)
    # events are neither listed once per stage nor sorted by time
    assert "Window" not in found._jdf.queryExecution().toString()
    got = {r.event_id: r.visible_s for r in found.collect()}

    def by_hand(video, t):
        ends = [0.0, *clips.SEARCH_OFFSETS]
        for low, high in zip(ends, clips.SEARCH_OFFSETS):
            inside = [] if t is None else [s for s in bright.get(video, []) if math.floor(max(t + low, 0.0)) <= s <= int(t + high)]
            if high >= low and inside:
                return min(inside)
        return None

    assert got == {i: by_hand(v, t) for i, (v, t) in enumerate(probes)}
