"""Chunked order operations against plain Python, with chunks far smaller than the data."""

import random
import statistics

from pyspark.sql import functions as F

from rollcall.operators import voices
from rollcall.operators.ordered import following, number_rows


def test_number_rows_over_gaps(spark, small_chunks):
    rng = random.Random(1)
    rows = [(job, i) for job in "ab" for i in sorted(rng.sample(range(200), 37))]
    df = spark.createDataFrame(rows, "job_id string, idx long")
    got = {(r.job_id, r.idx): r.n for r in number_rows(df, ["job_id"], "idx", "n").collect()}
    for job in "ab":
        for place, idx in enumerate(sorted(i for j, i in rows if j == job), 1):
            assert got[(job, idx)] == place


def test_following_skips_empty_chunks(spark, small_chunks):
    values = [0, 1, 2, 30, 31, 99]
    df = spark.createDataFrame([("a", v, v * 1.5) for v in values], "job_id string, idx long, t double")
    got = {r.idx: r.nxt for r in following(df, ["job_id"], "idx", F.floor(F.col("idx") / 4), "t", "nxt").collect()}
    assert got == {a: b * 1.5 if b is not None else None for a, b in zip(values, [*values[1:], None])}


def _medians(labels):
    if len(labels) <= 5:
        return labels
    padded = [0, 0, *labels, 0, 0]
    return [int(statistics.median(padded[i:i + 5])) for i in range(len(labels))]


def _segments(labels, times):
    runs, out = [], []
    for i, label in enumerate(labels):
        if not runs or labels[runs[-1]] != label:
            runs.append(i)
    for n, i in enumerate(runs):
        end = times[runs[n + 1]] if n + 1 < len(runs) else times[-1]
        if end - times[i] >= 0.8:
            out.append((f"speaker_{labels[i]}", max(times[i] - 0.75, 0.0), end + 0.75))
    return out


def test_voice_segments_across_chunks(spark, small_chunks):
    rng = random.Random(7)
    jobs = {}
    for job, n in (("a", 61), ("b", 5), ("c", 1), ("d", 24)):
        labels = []
        while len(labels) < n:
            labels += [rng.randrange(3)] * rng.randrange(1, 7)
        jobs[job] = labels[:n]
    rows = [(job, i, 0.75 * (i + 1), label) for job, labels in jobs.items() for i, label in enumerate(labels)]
    df = spark.createDataFrame(rows, "job_id string, win_idx int, timestamp double, label int")
    smooth = voices.smooth_labels(df)
    got = {}
    for r in smooth.collect():
        got.setdefault(r.job_id, {})[r.win_idx] = r.label
    for job, labels in jobs.items():
        assert [got[job][i] for i in range(len(labels))] == _medians(labels)
    found = {}
    for r in voices.segments_from_labels(smooth).orderBy("job_id", "seg_idx").collect():
        found.setdefault(r.job_id, []).append((r.speaker_id, r.start, r.end))
    for job, labels in jobs.items():
        times = [0.75 * (i + 1) for i in range(len(labels))]
        assert found.get(job, []) == _segments(_medians(labels), times)


def test_runs_fixture(spark):
    rows = [("j", i, 0.75 * (i + 1), label) for i, label in enumerate([0, 0, 0, 1, 1, 1])]
    df = spark.createDataFrame(rows, "job_id string, win_idx int, timestamp double, label int")
    got = [(r.speaker_id, r.start, r.end) for r in voices.segments_from_labels(df).orderBy("seg_idx").collect()]
    assert got == [("speaker_0", 0.0, 3.75), ("speaker_1", 2.25, 5.25)]


def test_window_grid_drops_short_tail(spark):
    df = spark.createDataFrame([("a", 24000), ("b", 11999), ("c", 12000), ("d", 60000)], "job_id string, samples long")
    got = {}
    for r in voices.window_grid(df).collect():
        got.setdefault(r.job_id, []).append(r.timestamp)
    assert got["a"] == [0.75] and "b" not in got and got["c"] == [0.75]
    assert sorted(got["d"]) == [0.75, 1.5, 2.25]
