"""Documents, listings, pictures and stored tables: written by hand, read back."""

import json

from pyspark.sql import functions as F

from rollcall.operators import report
from rollcall.sources import documents, media, sinks, tables


def _document(folder, job, name, payload):
    (folder / job).mkdir(exist_ok=True)
    (folder / job / name).write_text(json.dumps(payload, indent=2))


def test_documents(spark, tmp_path):
    box = [1, 2, 3, 4]
    _document(tmp_path, "job a", "faces.json", {
        "video": "m.mp4", "sampled_videos": ["m.mp4", "x.mp4"], "noise_count": 1, "estimated_people": 1,
        "face_clusters": [{"cluster_id": "face_0", "sample_count": 2, "representative_bbox": box, "thumbnail_path": "face_thumbnails/face_0.jpg"}],
        "observations": [
            {"timestamp": 0.5, "bbox": box, "embedding": [0.1, 0.2], "lip_openness": 0.3, "cluster_id": "face_0", "source_video": "m.mp4"},
            {"timestamp": 0.0, "bbox": box, "embedding": [0.1, 0.2], "lip_openness": 0.3},
        ],
    })
    _document(tmp_path, "job a", "speakers.json", {"segments": [{"speaker_id": "speaker_1", "start": 0.0, "end": 2.0}]})
    _document(tmp_path, "job a", "correlation.json", {
        "speaker_face_mappings": [{"speaker_id": "speaker_1", "face_id": "face_0", "confidence": 1.0, "evidence_segments": 1}],
        "lower_thirds": [{"start": 0.0, "end": 2.0, "speaker_id": "speaker_1", "face_id": "face_0", "name": "face_0", "confidence": 1.0}],
    })
    _document(tmp_path, "job a", "labels.json", {"face_0": "Ann", "face_1": ""})
    _document(tmp_path, "b", "labels.json", {"face_9": "Bo"})
    _document(tmp_path, "job a", "clips.json", {"main_video": "m.mp4", "extra_videos": [], "all_clips": ["m.mp4"]})
    base = str(tmp_path)
    obs = documents.read_observations(spark, base).orderBy("obs_id").collect()
    assert [(r.job_id, r.obs_id, r.cluster_id, r.source_video, r.bbox.y2) for r in obs] == [
        ("job a", 0, "face_0", "m.mp4", 4), ("job a", 1, "", "", 4)
    ]
    assert documents.read_clusters(spark, base).first().sample_count == 2
    assert documents.read_face_envelopes(spark, base).first().sampled_videos == ["m.mp4", "x.mp4"]
    assert documents.read_speaker_segments(spark, base).first().seg_idx == 0
    assert documents.read_mappings(spark, base).first().mapping_order == 0
    assert documents.read_lower_thirds(spark, base).first().name == "face_0"
    labels = {(r.job_id, r.face_id): r.name for r in documents.read_labels(spark, base).collect()}
    assert labels == {("job a", "face_0"): "Ann", ("job a", "face_1"): "", ("b", "face_9"): "Bo"}
    assert documents.read_clip_lists(spark, base).first().all_clips == ["m.mp4"]
    assert documents.read_detections(spark, base).count() == 0
    given = spark.createDataFrame([("b", "face_1", "Cy")], "job_id string, face_id string, name string")
    kept = report.labels_in_force(documents.read_labels(spark, base), given)
    assert sorted((r.job_id, r.name) for r in kept.collect()) == [("b", "Cy"), ("job a", ""), ("job a", "Ann")]


def test_detections_document(spark, tmp_path):
    _document(tmp_path, "j", "all_detected_names.json", [{"name": "Bo", "timestamp": 3.26}, {"name": "Al", "timestamp": 1.0, "confidence": 30.04}])
    rows = documents.read_detections(spark, str(tmp_path))
    roster = report.intro_roster(rows).orderBy("timestamp", "ord").collect()
    assert [(r.name, r.timestamp, r.timecode, r.match_confidence, r.location) for r in roster] == [
        ("Al", 1.0, "0:01", 30.0, ""), ("Bo", 3.3, "0:03", 0.0, "")
    ]


def _text(spark, path, job):
    lines = spark.read.text(f"{path}/job_id={job}").collect()
    return "\n".join(r.value for r in lines)


def test_documents_round_trip(spark, tmp_path):
    segments = spark.createDataFrame(
        [("j", i, f"speaker_{i % 2}", float(i), i + 0.5) for i in range(7)], "job_id string, seg_idx long, speaker_id string, start double, end double"
    )
    thirds = segments.select("job_id", "seg_idx", "start", "end", "speaker_id", F.lit("face_0").alias("face_id"), F.lit('A "B"').alias("name"), F.lit(0.66666).alias("confidence"))
    mappings = spark.createDataFrame([("j", "speaker_0", "face_0", 0.5, 3, 2)],
                                     "job_id string, speaker_id string, face_id string, confidence double, evidence_segments long, mapping_order long")
    jobs = spark.createDataFrame([("j",), ("empty",)], "job_id string")
    path = str(tmp_path / "correlation")
    sinks.write_lines(sinks.correlation_document(mappings, thirds, jobs), ["section", "ord"], path)
    payload = json.loads(_text(spark, path, "j"))
    assert [t["start"] for t in payload["lower_thirds"]] == [float(i) for i in range(7)]
    assert payload["lower_thirds"][0]["name"] == 'A "B"' and payload["speaker_face_mappings"][0]["evidence_segments"] == 3
    assert json.loads(_text(spark, path, "empty")) == {"speaker_face_mappings": [], "lower_thirds": []}

    edl = str(tmp_path / "edl")
    sinks.write_lines(sinks.edl_lines(thirds), ["event_no", "part"], edl)
    lines = _text(spark, edl, "j").split("\n")
    assert lines[:2] == ["TITLE: Lower Third Markers", "FCM: NON-DROP FRAME"]
    assert lines[5:8] == [
        "002  AX       V     C        00:00:01.000 00:00:01.500 00:00:01.000 00:00:01.500",
        '* FROM CLIP NAME: A "B"', "* COMMENT: speaker=speaker_1 face=face_0 confidence=0.67",
    ]
    csv = str(tmp_path / "csv")
    sinks.write_table(sinks.lower_third_csv_rows(thirds), ["seg_idx"], csv, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(csv).filter("job_id = 'j'").orderBy(F.col("seg_idx").cast("int")).collect()
    assert back[6].start_tc == "00:00:06.000" and back[6].confidence == "0.667" and back[6]["name"] == 'A "B"'


def test_faces_and_spoken_documents(spark, tmp_path):
    box = F.struct(*[F.lit(i).alias(s) for i, s in enumerate(("x1", "y1", "x2", "y2"))])
    obs = spark.range(3).select(F.lit("j").alias("job_id"), F.col("id").alias("obs_id"), F.lit("m").alias("source_video"), F.lit(0.5).alias("timestamp"),
                                box.alias("bbox"), F.array(F.lit(0.5)).alias("embedding"), F.lit(0.1).alias("lip_openness"), F.lit("face_0").alias("cluster_id"))
    clusters = obs.limit(1).select("job_id", "cluster_id", F.lit(3).cast("long").alias("sample_count"), box.alias("representative_bbox"), F.lit("t").alias("thumbnail_path"))
    clips = spark.createDataFrame([("j", 0, "m", True), ("j", 1, "x", False)], "job_id string, clip_idx int, source_video string, is_main boolean")
    noise = spark.createDataFrame([("j", 2)], "job_id string, noise_count long")
    path = str(tmp_path / "faces")
    sinks.write_lines(sinks.faces_document(clips, clusters, obs, noise), ["section", "ord"], path)
    payload = json.loads(_text(spark, path, "j"))
    assert payload["video"] == "m" and payload["sampled_videos"] == ["m", "x"] and payload["noise_count"] == 2 and payload["estimated_people"] == 1
    assert len(payload["observations"]) == 3 and payload["observations"][0]["bbox"] == [0, 1, 2, 3]

    labels = spark.createDataFrame([("j", "face_0", "Bo")], "job_id string, face_id string, name string")
    found = spark.createDataFrame([("j", 5, "Bo", 1.5)], "job_id string, ord long, name string, timestamp double")
    spoken = str(tmp_path / "spoken")
    jobs = spark.createDataFrame([("j",), ("k",)], "job_id string")
    sinks.write_lines(sinks.spoken_names_document(labels, found, jobs), ["section", "ord"], spoken)
    assert json.loads(_text(spark, spoken, "j")) == {"labels": {"face_0": "Bo"}, "all_detections": [{"name": "Bo", "timestamp": 1.5}]}
    assert json.loads(_text(spark, spoken, "k")) == {"labels": {}, "all_detections": []}


def test_listing_and_manifest(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "notes.txt", "c.webm", "noext"):
        (tmp_path / name).write_bytes(b"x")
    found = media.video_files(media.list_files(spark, str(tmp_path)).withColumn("job_id", F.lit("j")))
    rows = media.number_clips(found).orderBy("clip_idx").collect()
    assert [(r.path.rsplit("/", 1)[1], r.clip_idx) for r in rows] == [("a.mov", 0), ("b.MP4", 1), ("c.webm", 2)]
    plan = media.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    main = spark.createDataFrame([("j", "m")], "job_id string, source_video string")
    extras = spark.createDataFrame([("j", "x", 3), ("j", "m", 1), ("j", "a", 5), ("j", "x", 9)], "job_id string, source_video string, ord long")
    got = media.clip_manifest(main, extras).orderBy("clip_idx").collect()
    assert [(r.clip_idx, r.source_video, r.is_main) for r in got] == [(0, "m", True), (1, "x", False), (2, "a", False)]


def _png(path, width, height, grey):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + bytes([grey] * 3 * width) for _ in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_picture_stats(spark, tmp_path):
    _png(tmp_path / "bright.png", 90, 40, 120)
    _png(tmp_path / "dark.png", 90, 40, 10)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.brightness) for r in media.picture_stats(spark, str(tmp_path)).collect()}
    assert got == {"bright.png": (90, 40, 120.0), "dark.png": (90, 40, 10.0)}


def test_store_and_load_prunes_buckets(spark, tmp_path):
    path = str(tmp_path / "obs")
    table = spark.createDataFrame([(f"job_{i % 5}", i) for i in range(100)], "job_id string, obs_id long")
    tables.store(table, path, ["obs_id"])
    assert tables.load(spark, path).count() == 100
    some = tables.load(spark, path, ["job_3"])
    assert some.count() == 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "job_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_records_of_lines_need_no_whole_document(spark):
    from pyspark.sql import functions as F

    from rollcall import schemas
    from rollcall.sources import documents, sinks

    segments = spark.createDataFrame([(j, 7 * k, f"s, {k}", k + 0.5, k + 1.5) for j in "ab" for k in range(9)], "job_id string, seg_idx long, speaker_id string, start double, end double")
    lines = sinks.speakers_document(segments, segments.select("job_id").distinct())
    texts = lines.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda p: p["line"]), "\n").alias("value"))
    whole = documents.speaker_segments(documents.parse(texts, schemas.SPEAKERS_DOC))
    each = documents.segment_rows(documents.records(lines, 0, schemas.SPEAKERS_DOC["segments"].dataType.elementType, "seg_idx", "s"))
    assert sorted(each.select(*whole.columns).collect()) == sorted(whole.collect()) and each.count() == 18
