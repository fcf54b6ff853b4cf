"""Row types of the tables the operators exchange. Every table also carries ``job_id``."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)


def _struct(spec: dict) -> StructType:
    return StructType([StructField(name, kind) for name, kind in spec.items()])


TEXT, WHOLE, BIG, REAL, FLAG = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

BBOX = _struct({"x1": WHOLE, "y1": WHOLE, "x2": WHOLE, "y2": WHOLE})
POINT = _struct({"x": FloatType(), "y": FloatType(), "z": FloatType()})

CLIPS = _struct({
    "job_id": TEXT, "clip_idx": WHOLE, "source_video": TEXT, "is_main": FLAG,
    "width": WHOLE, "height": WHOLE, "native_fps": REAL, "duration_s": REAL,
})
FRAMES = _struct({"job_id": TEXT, "source_video": TEXT, "frame_idx": BIG, "timestamp": REAL, "brightness": REAL})
LANDMARKS = _struct({
    "job_id": TEXT, "source_video": TEXT, "timestamp": REAL, "pass": WHOLE, "face_idx": WHOLE,
    "width": WHOLE, "height": WHOLE, "points": ArrayType(POINT),
})
OBSERVATIONS = _struct({
    "job_id": TEXT, "obs_id": BIG, "source_video": TEXT, "timestamp": REAL, "bbox": BBOX,
    "embedding": ArrayType(FloatType()), "lip_openness": REAL, "cluster_id": TEXT,
})
FACE_CLUSTERS = _struct({
    "job_id": TEXT, "cluster_id": TEXT, "sample_count": BIG, "representative_bbox": BBOX, "thumbnail_path": TEXT,
})
VOICE_WINDOWS = _struct({"job_id": TEXT, "win_idx": WHOLE, "timestamp": REAL, "embedding": ArrayType(FloatType())})
SPEAKER_SEGMENTS = _struct({"job_id": TEXT, "seg_idx": BIG, "speaker_id": TEXT, "start": REAL, "end": REAL})
TRANSCRIPT_SEGMENTS = _struct({
    "job_id": TEXT, "source_video": TEXT, "seg_idx": BIG, "start": REAL, "end": REAL, "text": TEXT,
})
MAPPINGS = _struct({
    "job_id": TEXT, "speaker_id": TEXT, "face_id": TEXT, "confidence": REAL, "evidence_segments": BIG,
    "mapping_order": BIG,
})
LOWER_THIRDS = _struct({
    "job_id": TEXT, "seg_idx": BIG, "start": REAL, "end": REAL, "speaker_id": TEXT, "face_id": TEXT,
    "name": TEXT, "confidence": REAL,
})
LABELS = _struct({"job_id": TEXT, "face_id": TEXT, "name": TEXT})
THUMBNAILS = _struct({"job_id": TEXT, "path": TEXT, "width": WHOLE, "height": WHOLE, "brightness": REAL})
DETECTIONS = _struct({
    "job_id": TEXT, "ord": BIG, "name": TEXT, "name_heard": TEXT, "timestamp": REAL, "transcript": TEXT,
    "context_transcript": TEXT, "confidence": REAL, "face_id": TEXT, "lip_score": REAL, "source_video": TEXT,
    "clip_label": TEXT, "thumbnail_file": TEXT, "location": TEXT, "name_spelling": TEXT, "spelling_note": TEXT,
    "pronunciation": TEXT, "intro_clip_file": TEXT, "intro_clip_start": REAL, "intro_clip_duration": REAL,
    "intro_clip_faces_visible": BIG, "intro_clip_includes_full_cast": FLAG, "intro_clip_audio_realigned": FLAG,
})

# One document per job, as stored on disk. Boxes are four-number arrays there.
_STORED_OBSERVATION = _struct({
    "timestamp": REAL, "bbox": ArrayType(WHOLE), "embedding": ArrayType(FloatType()), "lip_openness": REAL,
    "cluster_id": TEXT, "source_video": TEXT,
})
_STORED_CLUSTER = _struct({
    "cluster_id": TEXT, "sample_count": BIG, "representative_bbox": ArrayType(WHOLE), "thumbnail_path": TEXT,
})
FACES_DOC = _struct({
    "video": TEXT, "sampled_videos": ArrayType(TEXT), "face_clusters": ArrayType(_STORED_CLUSTER),
    "observations": ArrayType(_STORED_OBSERVATION), "noise_count": BIG, "estimated_people": BIG,
})
SPEAKERS_DOC = _struct({"segments": ArrayType(_struct({"speaker_id": TEXT, "start": REAL, "end": REAL}))})
CORRELATION_DOC = _struct({
    "speaker_face_mappings": ArrayType(_struct({
        "speaker_id": TEXT, "face_id": TEXT, "confidence": REAL, "evidence_segments": BIG,
    })),
    "lower_thirds": ArrayType(_struct({
        "start": REAL, "end": REAL, "speaker_id": TEXT, "face_id": TEXT, "name": TEXT, "confidence": REAL,
    })),
})
CLIPS_DOC = _struct({"main_video": TEXT, "extra_videos": ArrayType(TEXT), "all_clips": ArrayType(TEXT)})
LABELS_DOC = MapType(TEXT, TEXT)
