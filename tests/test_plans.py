"""Whole runs over small jobs with a known answer, and the checked queries against their oracles."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection
from rollcall import schemas
from rollcall.plans import jobs

SMALL = "/root/testdata/sf0.001"


def _footage(spark, names=("ada", "bob")):
    """One two-person interview per name: person 0 speaks for 12 s, then person 1, both in view all the time."""
    clips, frames, faces, voices, said = [], [], [], [], []
    for job in names:
        clips.append((job, 0, f"/v/{job}.mp4", True, 1920, 1080, 25.0, 26.0))
        for i in range(0, 625, 12):
            t = i / 25.0
            frames.append((job, f"/v/{job}.mp4", i, t, 80.0))
            for person in (0, 1):
                speaking = (t < 12) == (person == 0)
                left = 200 + 900 * person
                look = [1.0, 0.1, 0.0] if person else [0.0, 0.1, 1.0]
                lip = 0.9 if speaking and i % 24 else 0.05
                faces.append((job, i * 2 + person, f"/v/{job}.mp4", t, (left, 300, left + 200, 520), look, lip, ""))
        for w in range(32):
            at = 0.75 * (w + 1)
            voices.append((job, w, at, [1.0, 0.0] if at < 12 else [0.0, 1.0]))
        said.append((job, f"/v/{job}.mp4", 0, 2.15, 4.0, f"Hi, I'm {job} and I'm from Ohio."))
        said.append((job, f"/v/{job}.mp4", 1, 15.05, 17.0, "My name is Cory. "))
        said.append((job, f"/v/{job}.mp4", 2, 18.0, 19.0, " with a K, C-O-R-Y"))
        said.append((job, f"/v/{job}.mp4", 3, 21.0, 22.0, "My name is Cory"))
    return jobs.Footage(
        clips=spark.createDataFrame(clips, schemas.CLIPS), frames=spark.createDataFrame(frames, schemas.FRAMES),
        voice_windows=spark.createDataFrame(voices, schemas.VOICE_WINDOWS),
        transcript_segments=spark.createDataFrame(
            [(j, v, i, s, e, x) for j, v, i, s, e, x in said], schemas.TRANSCRIPT_SEGMENTS
        ),
        observations=spark.createDataFrame(faces, schemas.OBSERVATIONS),
    )


@pytest.fixture(scope="module")
def analysed(spark):
    footage = _footage(spark)
    return footage, jobs.analyse(footage, max_speakers=2)


def test_analysis_names_both_people(analysed):
    _, results = analysed
    summary = {r.job_id: r for r in results.summary.collect()}
    assert {(r.face_cluster_count, r.clip_count, r.extra_video_count) for r in summary.values()} == {(2, 1, 0)}
    labels = {(r.job_id, r.face_id): r.name for r in results.labels.collect()}
    assert labels == {("ada", "face_0"): "ada", ("ada", "face_1"): "Cory", ("bob", "face_0"): "bob", ("bob", "face_1"): "Cory"}
    mapped = {(r.job_id, r.speaker_id): r.face_id for r in results.mappings.collect()}
    assert mapped == {(j, f"speaker_{n}"): f"face_{n}" for j in ("ada", "bob") for n in (0, 1)}
    found = {(r.job_id, r.name): r for r in results.detections.collect()}
    assert found[("ada", "Kory")].name_heard == "Cory" and found[("ada", "Kory")].name_spelling == "K-O-R-Y"
    assert found[("bob", "bob")].location == "Ohio"
    assert found[("bob", "bob")].intro_clip_file == "intro_clips/bob_2_bob.mp4"
    assert found[("bob", "bob")].intro_clip_faces_visible == 2
    assert len(found) == 4  # the second "My name is Cory" is a repeat within the window
    sheet = {(r.job_id, r.face_id): (r.name, r.speaker_id, r.sample_count) for r in results.face_sheet.collect()}
    assert sheet[("ada", "face_1")] == ("Cory", "speaker_1", 53)


def test_finalise_and_write(spark, analysed, tmp_path):
    _, results = analysed
    confirmed = spark.createDataFrame([("ada", "face_0", "Ada L."), ("bob", "face_1", "")], schemas.LABELS)
    finals = jobs.finalise(results.lower_thirds, results.mappings, results.observations, results.face_clusters, confirmed, results.detections)
    jobs.write_finals(finals, str(tmp_path))
    rows = spark.read.option("header", True).csv(str(tmp_path / "lower_thirds_csv")).filter("job_id = 'ada'").orderBy("seg_idx").collect()
    assert [r["name"] for r in rows] == ["Ada L.", "face_1"] and rows[0].start_tc == "00:00:00.000"
    markers = spark.read.text(str(tmp_path / "lower_third_markers")).filter("job_id = 'ada'")
    assert markers.count() == 2 + 3 * 2
    grabbed = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "named_screengrab" / "job_id=ada")).collect()]
    assert {(g["face_id"], g["label"]) for g in grabbed} == {("face_0", "Ada L."), ("face_1", "face_1")}
    roster = spark.read.option("header", True).csv(str(tmp_path / "intro_roster_csv")).filter("job_id = 'ada'").collect()
    assert [r["name"] for r in roster] == ["ada", "Kory"]
    at = spark.createDataFrame([("ada", 0.0)], "job_id string, chosen_ts double")
    again = jobs.finalise(results.lower_thirds, results.mappings, results.observations, results.face_clusters, confirmed, results.detections, at)
    assert {r.timestamp for r in again.screengrab.filter("job_id = 'ada'").collect()} == {0.0}


def test_rebuild_reclusters_stored_observations(spark):
    footage = _footage(spark, ("ada",))
    stored = footage.observations.withColumn("cluster_id", F.lit("face_9"))
    segments = spark.createDataFrame([("ada", 0, "speaker_0", 0.0, 12.0), ("ada", 1, "speaker_1", 12.0, 24.0)], schemas.SPEAKER_SEGMENTS)
    again = jobs.rebuild(stored, segments, footage.frames, footage.transcript_segments, footage.clips)
    assert sorted((r.face_id, r.name) for r in again.labels.collect()) == [("face_0", "ada"), ("face_1", "Cory")]
    assert sorted((r.speaker_id, r.face_id) for r in again.mappings.collect()) == [("speaker_0", "face_0"), ("speaker_1", "face_1")]


def test_landmark_input_numbers_faces_in_list_order(spark):
    clips = spark.createDataFrame([("j", 0, "m", True, 0, 0, 25.0, 9.0), ("j", 1, "x", False, 0, 0, 25.0, 9.0)], schemas.CLIPS)
    point = [(0.1, 0.2, 0.0)] * 15
    marks = spark.createDataFrame(
        [("j", "x", 0.0, 1, 0, 100, 100, point), ("j", "m", 0.5, 2, 0, 100, 100, point), ("j", "m", 0.5, 1, 1, 100, 100, point),
         ("j", "m", 0.5, 1, 0, 100, 100, point), ("j", "m", 0.04, 1, 0, 100, 100, point)], schemas.LANDMARKS,
    )
    from rollcall.operators.sampling import observations_from_landmarks

    rows = jobs.number_observations(
        observations_from_landmarks(marks).withColumn("tag", F.concat_ws("/", "source_video", "pass", "timestamp", "face_idx")), clips
    ).orderBy("obs_id").collect()
    assert [r.tag for r in rows] == ["m/1/0.04/0", "m/1/0.5/0", "m/1/0.5/1", "m/2/0.5/0", "x/1/0.0/0"]
    assert (rows[0].bbox.x1, rows[0].bbox.y2, len(rows[0].embedding)) == (0, 30, 45)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


LIGHT = ["lower_third_timeline", "k3_edl_markers", "t18_intro_details", "p2_intro_pass", "a2_assign_faces", "c11_cluster_summary"]


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_oracle(spark, name):
    ok, note = compare(spark, oracle_connection(SMALL), SMALL, name)
    assert ok, note


def test_every_query_but_three_has_an_oracle():
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(entry.oracle_sql()) == {"c3_k_cluster_faces", "c12_recluster_faces", "v3_k_cluster_voices"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
