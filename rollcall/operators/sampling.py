"""Which frames are looked at, and what a detected face row holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import vectors
from rollcall.operators.joins import join_facts

# Fixed values of the sampling rules.
DEFAULT_FPS = 30.0
INTRO_LIMIT_S = 180.0
INTRO_FPS = 2.5
RANGE_FPS = 8.0
DEFAULT_WIDTH, DEFAULT_HEIGHT = 1920.0, 1080.0
MIN_FRAME_BRIGHTNESS = 12.0
MIN_THUMBNAIL_BRIGHTNESS = 20.0
FAST_LIMIT_S, FAST_FPS = 600.0, 1.0
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".mkv", ".avi", ".webm")


def known_fps(fps: Column) -> Column:
    return F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(DEFAULT_FPS))


def stride(fps: Column, sample_fps: Column) -> Column:
    """Frames between two samples; half-even rounding, at least one."""
    return F.greatest(F.bround(known_fps(fps) / sample_fps).cast("long"), F.lit(1).cast("long"))


def sample_frames(frames: DataFrame, sample_fps: float, max_s: Column | None = None) -> DataFrame:
    """Every ``stride``-th frame up to the limit. ``frames`` carries ``native_fps``."""
    fps = known_fps(F.col("native_fps"))
    kept = frames.filter(F.pmod("frame_idx", stride(F.col("native_fps"), F.lit(sample_fps))) == 0)
    if max_s is not None:
        kept = kept.filter(max_s.isNull() | (F.col("frame_idx") <= (max_s * fps).cast("long")))
    return kept.withColumn("timestamp", F.col("frame_idx") / fps)


def sample_with_intro_pass(frames: DataFrame, sample_fps: float, max_s: Column | None = None) -> DataFrame:
    """The normal pass plus a denser pass over the opening; frames seen by both stay in twice."""
    limit = F.lit(None).cast("double") if max_s is None else max_s
    intro = F.least(F.coalesce(F.nullif(limit, F.lit(0.0)), F.lit(INTRO_LIMIT_S)), F.lit(INTRO_LIMIT_S))
    first = sample_frames(frames, sample_fps, limit).withColumn("pass", F.lit(1))
    second = sample_frames(frames, max(sample_fps, INTRO_FPS), intro).withColumn("pass", F.lit(2))
    return first.unionByName(second)


def duration_limits(
    clips: DataFrame, max_s: float | None = None, extra_max_s: float | None = None, fast: bool = False
) -> DataFrame:
    """Seconds analysed per clip. A missing or zero limit for extras falls back to the main one."""
    if fast:
        max_s, extra_max_s = FAST_LIMIT_S, FAST_LIMIT_S
    main = F.lit(max_s).cast("double")
    extra = F.coalesce(F.nullif(F.lit(extra_max_s).cast("double"), F.lit(0.0)), main)
    return clips.withColumn("limit_s", F.when(F.col("is_main"), main).otherwise(extra))


def frames_to_analyse(
    frames: DataFrame, clips: DataFrame, sample_fps: float = 2.0, max_s: float | None = None,
    extra_max_s: float | None = None, fast: bool = False,
) -> DataFrame:
    """P1 to P3 over the frame table of many jobs."""
    limits = duration_limits(clips, max_s, extra_max_s, fast).select(
        "job_id", "source_video", "native_fps", "limit_s"
    )
    joined = join_facts(frames, limits, ["job_id", "source_video"], spread=["frame_idx"])
    return sample_with_intro_pass(joined, FAST_FPS if fast else sample_fps, F.col("limit_s")).drop("limit_s")


def sample_range(frames: DataFrame, start_s: Column, end_s: Column, sample_fps: float = RANGE_FPS) -> DataFrame:
    """Strided frames of ``[start, end]``, counted from the start frame."""
    fps = known_fps(F.col("native_fps"))
    first, last = (start_s * fps).cast("long"), (end_s * fps).cast("long")
    step = stride(F.col("native_fps"), F.lit(sample_fps))
    return frames.filter(F.col("frame_idx").between(first, last)).filter(
        F.pmod(F.col("frame_idx") - first, step) == 0
    ).withColumn("timestamp", F.col("frame_idx") / fps)


def observations_from_landmarks(landmarks: DataFrame) -> DataFrame:
    """One observation per detected face, without an id or a cluster."""
    points = F.col("points")
    return landmarks.select(
        "job_id", "source_video", "timestamp", "pass", "face_idx",
        vectors.bounding_box(points, F.col("width"), F.col("height")).alias("bbox"),
        vectors.landmark_embedding(points).alias("embedding"),
        vectors.lip_openness(points).alias("lip_openness"),
    )


def frame_sizes(clips: DataFrame) -> DataFrame:
    """Frame size of each job's main clip; missing or zero becomes 1920x1080."""
    return clips.filter("is_main").select(
        "job_id",
        F.coalesce(F.nullif(F.col("width").cast("double"), F.lit(0.0)), F.lit(DEFAULT_WIDTH)).alias("frame_width"),
        F.coalesce(F.nullif(F.col("height").cast("double"), F.lit(0.0)), F.lit(DEFAULT_HEIGHT)).alias("frame_height"),
    )


def add_features(observations: DataFrame, sizes: DataFrame) -> DataFrame:
    """Clustering features, using the main clip's frame size also for extra clips."""
    joined = join_facts(observations, sizes, ["job_id"], spread=["obs_id"], how="left")
    width = F.coalesce("frame_width", F.lit(DEFAULT_WIDTH))
    height = F.coalesce("frame_height", F.lit(DEFAULT_HEIGHT))
    feature = vectors.cluster_feature(F.col("embedding"), F.col("bbox"), width, height)
    return joined.withColumn("feature", feature).drop("frame_width", "frame_height")


def usable_thumbnail(width: Column, height: Column, brightness: Column) -> Column:
    """Exists, is a crop rather than a whole frame, bright enough and not tiny."""
    whole_frame = (width > 900) & (height > 500)
    usable = ~whole_frame & (brightness >= MIN_THUMBNAIL_BRIGHTNESS) & (F.greatest(width, height) >= 80)
    return F.coalesce(usable, F.lit(False))


def bright_frames(frames: DataFrame) -> DataFrame:
    """P10: frames that are not dark."""
    return frames.filter(F.col("brightness") >= MIN_FRAME_BRIGHTNESS)


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "^.+(\\.[^.]+)$", 1))


def split_uploads(uploads: DataFrame, name: str = "upload_name") -> tuple[DataFrame, DataFrame]:
    """Uploads with an accepted video suffix, and the rejected rest with a reason."""
    suffix = path_suffix(F.col(name))
    accepted = uploads.filter(suffix.isin(*VIDEO_SUFFIXES))
    rejected = uploads.filter(~suffix.isin(*VIDEO_SUFFIXES)).withColumn(
        "reason",
        F.format_string(
            "Unsupported file type: %s. Upload MP4, MOV, or similar video files.",
            F.when(suffix == "", "(none)").otherwise(suffix),
        ),
    )
    return accepted, rejected
