"""Cases in which rows once went missing or orders collided, and the entry module without its optional part."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.operators import clustering, names
from rollcall.operators.ordered import number_sorted
from rollcall.sources import documents, media, sinks

ROOT = Path(__file__).resolve().parents[1]


def test_numbers_have_no_gaps_for_many_clips_and_equal_times(spark):
    rows = [("j", c, i, 1.0) for c in range(300) for i in range(3)] + [("k", 5, 0, 2.0)]
    df = spark.createDataFrame(rows, "job_id string, clip_idx int, seg_idx int, timestamp double").repartition(7)
    got = number_sorted(df, ["job_id"], ["timestamp", "clip_idx", "seg_idx"], "ord").orderBy("job_id", "ord").collect()
    assert [(r.job_id, r.clip_idx, r.seg_idx) for r in got] == [r[:3] for r in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2]))]
    assert [r.ord for r in got] == [*range(900), 0]


def test_clips_are_numbered_by_whole_paths(spark):
    paths = ["/v/bca.mp4", "/v/bcz.mp4", "/v/bca/x.mp4"] + [f"/v/IMG_{i:04d}.mov" for i in range(40)]
    listing = spark.createDataFrame([("j", p) for p in paths], "job_id string, path string")
    assert [r.path for r in media.number_clips(listing).orderBy("clip_idx").collect()] == sorted(paths)


def test_unknown_clip_length_sets_no_limit(spark):
    rows = [("j", "a", 0, 5.0, "said", None), ("j", "a", 1, 5.0, "late", 4.0), ("j", "a", 2, 5.0, "zero", 0.0), ("j", "a", 3, 5.0, "in time", 5.0)]
    df = spark.createDataFrame(rows, "job_id string, source_video string, seg_idx int, start double, text string, limit_s double")
    assert {r.text for r in names.clean_segments(df, "limit_s").collect()} == {"said", "zero", "in time"}


def test_voices_start_at_their_first_window(spark):
    windows = [("late", w, [1.0, 0.0] if w < 5 else [0.0, 1.0]) for w in range(1, 9)] + [("uncounted", w, [1.0, 0.1]) for w in range(3)]
    df = spark.createDataFrame(windows, "job_id string, win_idx int, embedding array<double>")
    counts = spark.createDataFrame([("late", 2)], "job_id string, k int")
    rows = clustering.k_cluster_voices(df, counts).collect()
    assert [r.label for r in sorted(rows, key=lambda r: r.win_idx) if r.job_id == "late"] == [0] * 4 + [1] * 4
    assert [r.label for r in rows if r.job_id == "uncounted"] == [0] * 3


def test_contexts_listen_to_the_main_clip_only(spark):
    said = [("j", "main", 0, 10.0, "here"), ("j", "extra", 1, 10.5, "elsewhere"), ("j", "main", 2, 12.0, "and here")]
    segments = spark.createDataFrame(said, "job_id string, source_video string, seg_idx int, start double, text string")
    clips = spark.createDataFrame([("j", "main", True), ("j", "extra", False)], "job_id string, source_video string, is_main boolean")
    found = names.bounded_contexts(spark.createDataFrame([("j", 10.0)], "job_id string, timestamp double"), segments, clips)
    assert [r.context_transcript for r in found.collect()] == ["here and here"]


def test_screengrab_document_keeps_jobs_without_faces(spark):
    faces = spark.createDataFrame([("a", 1.5, "face_0")], "job_id string, chosen_ts double, cluster_id string")
    labels = spark.createDataFrame([("a", "face_0", "Ann")], "job_id string, face_id string, name string")
    clips = spark.createDataFrame([("a", "x.mp4", True), ("b", "y.mp4", True)], "job_id string, source_video string, is_main boolean")
    chosen = spark.createDataFrame([("a", 1.5), ("b", 0.0)], "job_id string, chosen_ts double")
    docs = {r.job_id: json.loads(r.line) for r in sinks.screengrab_document(faces, labels, clips, chosen).collect()}
    assert docs["a"]["labels"] == {"face_0": "Ann"} and docs["b"]["labels"] == {} and docs["b"]["video"] == "y.mp4"


def test_spoken_names_document_parses_with_equal_times(spark):
    rows = [("j", 3.0, f"N{i}") for i in range(4)]
    found = number_sorted(spark.createDataFrame(rows, "job_id string, timestamp double, name string"), ["job_id"], ["timestamp", "name"], "ord")
    labels = spark.createDataFrame([("j", "face_0", "Ann")], "job_id string, face_id string, name string")
    lines = sinks.spoken_names_document(labels, found, found.select("job_id").distinct()).orderBy("section", "ord").collect()
    doc = json.loads("\n".join(r.line for r in lines))
    assert [d["name"] for d in doc["all_detections"]] == ["N0", "N1", "N2", "N3"] and doc["labels"] == {"face_0": "Ann"}


def test_malformed_documents_are_not_silently_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "speakers.json").write_text('{"segments": [{"speaker_id": "s", "start": 0.0,')
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.read_speaker_segments(spark, str(tmp_path)).collect()


def test_task_code_needs_no_package_on_the_workers(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from rollcall.session import build_session\n"
        "from rollcall.operators import clustering\n"
        "spark = build_session('elsewhere', master='local[2]', partitions=2)\n"
        "df = spark.createDataFrame([('j', w, [float(w > 1), 1.0]) for w in range(4)], 'job_id string, win_idx int, embedding array<double>')\n"
        "k = spark.createDataFrame([('j', 2)], 'job_id string, k int')\n"
        "print('LABELS', sorted((r.win_idx, r.label) for r in clustering.k_cluster_voices(df, k).collect()))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "LABELS [(0, 0), (1, 0), (2, 1), (3, 1)]" in done.stdout, done.stderr[-2000:]


def test_entry_works_without_the_text_part(tmp_path):
    for name in ("checks", "rollcall"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('NAMES', len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split("NAMES ")[1].split()[1:] == ["0", "True"], done.stderr[-2000:]
