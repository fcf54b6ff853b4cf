"""Documents read through the structural index against the JSON parser, for any size of split."""

import json
import random
from pathlib import Path

import pytest

from rollcall.session import shared_folder
from rollcall.sources import documents, structural


def text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", "日", " "]) for _ in range(rng.randint(0, 12)))


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 2 else 4)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 5:
        return {text(rng): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [text(rng), rng.random(), None, True][kind]


def record(rng):
    return {f"k{i}": value(rng) for i in range(rng.randint(0, 4))}


def write(folder, job, doc, rng, name="doc.json"):
    (folder / job).mkdir()
    (folder / job / name).write_text(json.dumps(doc, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")


@pytest.fixture
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split_bytes", [23, 150, 1 << 20], indirect=True)
def test_records_and_envelopes_equal_the_parsers(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    docs = {}
    for k in range(6):
        members = [("video", text(rng)), ("one", [record(rng) for _ in range(rng.randint(0, 9))]), ("names", [text(rng) for _ in range(3)]),
                   ("two", [record(rng) for _ in range(rng.randint(0, 9))]), ("labels", {text(rng): text(rng) for _ in range(3)}), ("n", k)]
        rng.shuffle(members)
        docs[f"job {k}"] = dict(members)
    docs["none"] = {"one": [], "two": [], "names": []}
    docs["bare"] = {}
    for job, doc in docs.items():
        write(tmp_path, job, doc, rng)
    records, envelopes = structural.read_documents(spark, f"{tmp_path}/*/doc.json", {"one", "two"})
    got = {}
    for r in records.collect():
        assert got.setdefault((r.job_id, r.section, r.place), json.loads(r.text)) == json.loads(r.text)
    wanted = {(job, s, i): rec for job, doc in docs.items() for s in ("one", "two") for i, rec in enumerate(doc.get(s, []))}
    assert got == wanted
    rest = {r.job_id: json.loads(r.text) for r in envelopes.collect()}
    assert rest == {job: {**doc, **{s: [] for s in ("one", "two") if s in doc}} for job, doc in docs.items()}


@pytest.mark.parametrize("split_bytes", [31, 400], indirect=True)
def test_arrays_and_documents_of_several_files(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    lists = {f"j{k}": [{**record(rng), "place": i} for i in range(25 * k)] for k in range(3)}
    for job, rows in lists.items():
        (tmp_path / f"job_id={job}").mkdir()
        lines = ["[", *[json.dumps(r) + ("," if i + 1 < len(rows) else "") for i, r in enumerate(rows)], "]"]
        for part in range(3):
            (tmp_path / f"job_id={job}" / f"part-{part}.txt").write_text("".join(x + "\n" for x in lines[part * len(lines) // 3 : (part + 1) * len(lines) // 3]))
    records, envelopes = structural.read_documents(spark, f"{tmp_path}/*/part-*", {structural.ROOT})
    got = {(r.job_id, r.place): json.loads(r.text) for r in records.collect()}
    assert got == {(job, i): r for job, rows in lists.items() for i, r in enumerate(rows)}
    assert {r.job_id: "".join(r.text.split()) for r in envelopes.collect()} == dict.fromkeys(lists, "[]")


@pytest.mark.parametrize("split_bytes", [40, 1 << 20], indirect=True)
@pytest.mark.parametrize("broken", ['{"segments": [{"speaker_id": "s", "start": 0.0,', '{"segments": [{"speaker_id": "s}', '{"segments": []'])
def test_documents_that_end_early_are_an_error(spark, tmp_path, split_bytes, broken):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "speakers.json").write_text(broken)
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.read_speaker_segments(spark, str(tmp_path)).collect()


def test_one_document_spreads_over_many_tasks(spark, tmp_path):
    rows = [{"speaker_id": f"s{i % 3}", "start": float(i), "end": i + 0.5} for i in range(4_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "speakers.json").write_text(json.dumps({"segments": rows}, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert structural.pieces(spark, f"{tmp_path}/*/speakers.json").rdd.getNumPartitions() > 10
        got = documents.read_speaker_segments(spark, str(tmp_path)).orderBy("seg_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.seg_idx, r.speaker_id, r.start, r.end) for r in got] == [(i, r["speaker_id"], r["start"], r["end"]) for i, r in enumerate(rows)]
    assert documents.read_speaker_segments(spark, str(tmp_path / "nowhere")).count() == 0


def test_reading_one_section_writes_nothing_of_the_others(spark, tmp_path):
    rng = random.Random(5)
    boxes = {"timestamp": 1.0, "bbox": [0, 0, 9, 9], "embedding": [0.5], "lip_openness": 0.1, "cluster_id": "face_0"}
    rows = [{**boxes, "source_video": "".join(rng.choice("abcdefgh") for _ in range(500))} for _ in range(4_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "faces.json").write_text(json.dumps({"video": "v", "sampled_videos": ["v"], "face_clusters": [
        {"cluster_id": "face_0", "sample_count": 4_000, "representative_bbox": [0, 0, 9, 9], "thumbnail_path": "p"}], "observations": rows}))

    def written():
        return sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())

    before = written()
    faces = documents.read_face_envelopes(spark, str(tmp_path)).collect(), documents.read_clusters(spark, str(tmp_path)).collect()
    observations = documents.read_observations(spark, str(tmp_path))
    assert observations.groupBy().agg({"obs_id": "sum"}).first()[0] == 4_000 * 3_999 // 2
    assert [len(part) for part in faces] == [1, 1]
    assert written() - before < 1_000_000  # the document has over two million bytes
