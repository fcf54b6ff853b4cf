"""Greedy rules that run in rounds, against the one-by-one statement of the rule."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from rollcall.operators import assign, names


def _events(spark, rows):
    return spark.createDataFrame(
        rows, "job_id string, source_video string, name string, timestamp double, confidence double, event_ord long"
    )


def _keep(rows):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[4], r[5])):
        if not any(k[0] == row[0] and k[1] == row[1] and k[2].lower() == row[2].lower() and abs(k[3] - row[3]) <= 90 for k in kept):
            kept.append(row)
    return {(r[0], r[5]) for r in kept}


def test_repeat_chain(spark):
    rows = [("j", "c", "Ann", 0.0, 30.0, 0), ("j", "c", "ann", 80.0, 45.0, 1), ("j", "c", "Ann", 160.0, 28.0, 2)]
    assert [r.event_ord for r in names.keep_best_repeats(_events(spark, rows)).collect()] == [1]


def test_empty_events(spark):
    assert names.keep_best_repeats(_events(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_greedy_choice(spark, seed):
    rng = random.Random(seed)
    rows = []
    for job in ("j", "k"):
        for i in range(90):
            rows.append((job, rng.choice(["c", "d"]), rng.choice(["Ann", "ANN", "Bo"]), float(rng.choice([rng.randrange(900), rng.randrange(10) * 90])),
                         float(rng.choice([25, 30, 35, 40])), i))
    kept = names.keep_best_repeats(_events(spark, rows))
    assert {(r.job_id, r.event_ord) for r in kept.collect()} == _keep(rows)
    again = names.keep_best_repeats(kept)
    assert again.count() == kept.count()


def _assign(spark, wishes):
    events = spark.createDataFrame([("j", e, e) for e in range(len(wishes))], "job_id string, event_id long, event_ord long")
    ranked = spark.createDataFrame(
        [("j", e, face, 10.0 - rank, 0, 1, rank + 1) for e, faces in enumerate(wishes) for rank, face in enumerate(faces)],
        "job_id string, event_id long, face_id string, score double, obs_id long, seen long, face_rank int",
    )
    rows = assign.assign_faces(events, ranked).collect()
    assert len({r.face_id for r in rows}) == len(rows)
    return {r.event_id: r.face_id for r in rows}


def _one_by_one(wishes):
    taken, out = set(), {}
    for e, faces in enumerate(wishes):
        free = [f for f in faces if f not in taken]
        if free:
            out[e] = free[0]
            taken.add(free[0])
    return out


def test_greedy_fixture(spark):
    assert _assign(spark, [["f1", "f2"], ["f1", "f3"], ["f1"]]) == {0: "f1", 1: "f3"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.permutations(["f1", "f2", "f3", "f4", "f5"]).flatmap(lambda p: st.integers(0, 5).map(lambda n: p[:n])), min_size=1, max_size=14))
def test_greedy_matches_one_by_one(spark, wishes):
    if any(wishes):
        assert _assign(spark, wishes) == _one_by_one(wishes)


def test_exclusion_attempts_order(spark):
    df = spark.createDataFrame(
        [("j", 1, "", ["face_10", "face_2"]), ("j", 2, "face_1", ["face_2"]), ("j", 3, "", ["face_4"]), ("j", 4, "", [])],
        "job_id string, event_id long, preferred_face string, taken array<string>",
    )
    got = {}
    for r in assign.exclusion_attempts(df).orderBy("event_id", "attempt").collect():
        got.setdefault(r.event_id, []).append(sorted(r.excluded))
    assert got == {1: [["face_10", "face_2"], ["face_10"], ["face_2"], []], 2: [[]], 3: [["face_4"], []], 4: [[]]}


def test_late_face_keeps_zero_score(spark):
    events = spark.createDataFrame([("j", 0, 0), ("j", 1, 1)], "job_id string, event_id long, event_ord long")
    ranked = spark.createDataFrame([("j", e, "f1", 7.0, 0, 1, 1) for e in (0, 1)],
                                   "job_id string, event_id long, face_id string, score double, obs_id long, seen long, face_rank int")
    captures = spark.createDataFrame([("j", 1, 3, 5.0, "f1", 9.0, 1), ("j", 1, 4, 6.0, "f2", 2.0, 2)],
                                     "job_id string, event_id long, offset_rank int, frame_ts double, face_id string, score double, obs_id long")
    got = {r.event_id: (r.face_id, r.lip_score) for r in assign.assign_faces(events, ranked, captures).collect()}
    assert got == {0: ("f1", 7.0), 1: ("f2", 0.0)}


def test_no_faces_at_all(spark):
    events = spark.createDataFrame([("j", 0, 0)], "job_id string, event_id long, event_ord long")
    ranked = spark.createDataFrame([], "job_id string, event_id long, face_id string, score double, obs_id long, seen long, face_rank int")
    assert assign.assign_faces(events, ranked).count() == 0
