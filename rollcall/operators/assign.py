"""Which face belongs to a spoken name.

Events carry job_id, event_id, event_ord (list order inside the job), source_video and timestamp.
Frames are sampled, so "the frame at a time" is the nearest sampled one within a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.functions.scalars import artifact_name, clip_label
from rollcall.functions.vectors import face_score
from rollcall.operators.clips import SEARCH_OFFSETS
from rollcall.operators.joins import join_facts, nearest_time
from rollcall.operators.names import enrich_detections
from rollcall.operators.sampling import bright_frames, usable_thumbnail
from rollcall.session import cut_lineage

TOLERANCE_S = 0.5
FRAME = ["job_id", "source_video", "frame_ts"]
EVENT = ["job_id", "event_id"]


def faces_on_frames(matched: DataFrame) -> DataFrame:
    """Per frame and face the best score, the first observation with it and how often the face occurs.

    ``matched`` holds observations with their nearest cluster. One row per frame and face is all the
    assignment needs, and it is small before any event meets it.
    """
    scored = matched.filter(F.col("cluster_id") != "").withColumn(
        "_best", F.struct(face_score(F.col("bbox"), F.col("lip_openness")).alias("score"), (-F.col("obs_id")).alias("late"))
    )
    return scored.groupBy("job_id", "source_video", F.col("timestamp").alias("frame_ts"), "cluster_id").agg(
        F.max("_best").alias("_best"), F.count(F.lit(1)).alias("seen")
    ).select(*FRAME, F.col("cluster_id").alias("face_id"), "_best.score", (-F.col("_best.late")).alias("obs_id"), "seen")


def events_on_frames(events: DataFrame, frames: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """The nearest sampled frame of each event's clip; events with none in reach are left out."""
    found = nearest_time(
        events, frames, ["job_id", "source_video"], ["event_id"], "timestamp", "timestamp", tolerance_s, "frame_ts"
    )
    return events.select("job_id", "event_id", "source_video").join(found, ["job_id", "source_video", "event_id"])


def rank_faces(events: DataFrame, frames: DataFrame, faces: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """A1: faces on each event's frame, best score first; ``seen`` counts repeats of a face on the frame."""
    on_frame = events_on_frames(events, frames, tolerance_s).join(faces, FRAME)
    order = W.partitionBy(*EVENT).orderBy(F.desc("score"), "obs_id")
    return on_frame.withColumn("face_rank", F.row_number().over(order)).select(
        *EVENT, "face_id", "score", "obs_id", "seen", "face_rank"
    )


def probe_captures(events: DataFrame, frames: DataFrame, faces: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """A4: faces on the bright frames around each event, with the rank of the search offset that finds them.

    The 18 offsets are a literal array, so the search is one exploded column and one nearest-frame join.
    """
    offsets = F.array(*[F.lit(o) for o in SEARCH_OFFSETS])
    probes = events.select(
        *EVENT, "source_video", "timestamp", F.posexplode(offsets).alias("offset_rank", "_offset")
    ).withColumn("capture_ts", F.col("timestamp") + F.col("_offset")).filter("capture_ts >= 0")
    found = nearest_time(
        probes, frames, ["job_id", "source_video"], ["event_id", "offset_rank"],
        "capture_ts", "timestamp", tolerance_s, "frame_ts",
    )
    bright = bright_frames(frames).select("job_id", "source_video", F.col("timestamp").alias("frame_ts")).distinct()
    return found.join(faces.join(bright, FRAME, "left_semi"), FRAME).select(
        *EVENT, "offset_rank", "frame_ts", "face_id", "score", "obs_id"
    )


def pick_capture(candidates: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    """A5: at the first offset with a candidate, the face with the best score."""
    order = F.struct(F.col("offset_rank"), -F.col("score"), F.col("obs_id"))
    return candidates.groupBy(*keys).agg(
        F.min_by(F.struct("face_id", "frame_ts", "obs_id", "offset_rank", "score"), order).alias("_c")
    ).select(*keys, "_c.*")


def assign_faces(events: DataFrame, ranked: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """In event order each event takes its best face that no earlier event of the job took.

    With ``captures`` an event whose own frame has no free face takes the first free one its offset
    search finds; lip_score stays 0 then. Returns (event, face_id, lip_score) for events with a face.

    Events prefer faces in rank order and every face prefers the earliest event, so deferred acceptance
    ends in the same matching as going through the events one by one. Each round is two small
    aggregations; a face, once held, only moves to earlier events, so rounds are at most the number of
    faces of a job plus one, whatever the number of events.
    """

    def choice(step, place, last):
        return F.struct(step.cast("int").alias("step"), place.cast("double").alias("place"), last.cast("long").alias("last"))

    own = ranked.select(*EVENT, "face_id", "score", choice(F.lit(-1), F.col("face_rank"), F.lit(0)).alias("_choice"))
    if captures is not None:
        late = captures.groupBy(*EVENT, "face_id").agg(
            F.min(choice(F.col("offset_rank"), -F.col("score"), F.col("obs_id"))).alias("_choice")
        ).select(*EVENT, "face_id", F.lit(0.0).alias("score"), "_choice")
        own = own.unionByName(late.select(*own.columns))
    order = events.select(*EVENT, "event_ord")
    open_choices = cut_lineage(
        own.groupBy(*EVENT, "face_id").agg(F.min(F.struct("_choice", "score")).alias("_choice")).join(order, EVENT)
    )
    taken = None
    while True:
        if taken is not None:
            kept = join_facts(open_choices, taken, ["job_id", "face_id"], ["event_id"], "left").filter(
                F.col("_holder").isNull() | (F.col("_holder") >= F.col("event_ord"))
            ).drop("_holder")
            open_choices = cut_lineage(kept)
        wishes = open_choices.groupBy(*EVENT, "event_ord").agg(F.min_by("face_id", "_choice").alias("face_id"))
        holders = cut_lineage(wishes.groupBy("job_id", "face_id").agg(F.min("event_ord").alias("_holder")))
        if taken is not None:
            before = taken.select("job_id", "face_id", F.col("_holder").alias("_was"))
            changed = holders.join(before, ["job_id", "face_id"], "left").filter(~F.col("_holder").eqNullSafe(F.col("_was")))
            if changed.isEmpty():
                break
        taken = holders
    held = open_choices.join(
        taken.select("job_id", "face_id", F.col("_holder").alias("event_ord")), ["job_id", "face_id", "event_ord"]
    )
    return held.select(*EVENT, "event_ord", "face_id", F.col("_choice.score").alias("lip_score"))


def with_fallback_flag(events: DataFrame, ranked: DataFrame, assigned: DataFrame) -> DataFrame:
    """A3: whether a cluster picture may stand in: no score, or a crowded frame whose top face was taken before."""
    top = ranked.groupBy(*EVENT).agg(
        F.sum("seen").alias("_visible"), F.min_by("face_id", "face_rank").alias("_top_face")
    )
    owners = assigned.select("job_id", F.col("face_id").alias("_top_face"), F.col("event_ord").alias("_owner"))
    joined = (
        events.select(*EVENT, "event_ord")
        .join(top, EVENT, "left")
        .join(owners, ["job_id", "_top_face"], "left")
        .join(assigned.select(*EVENT, "face_id", "lip_score"), EVENT, "left")
    )
    crowded = (F.col("_visible") > 1) & (F.col("_owner") < F.col("event_ord"))
    return joined.select(
        *EVENT, F.coalesce("face_id", F.lit("")).alias("face_id"),
        F.coalesce("lip_score", F.lit(0.0)).alias("lip_score"),
        ((F.coalesce("lip_score", F.lit(0.0)) <= 0) | F.coalesce(crowded, F.lit(False))).alias("allow_fallback"),
    )


def taken_before(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per event the sorted array of faces that earlier events of its job took; bounded by the job's faces."""
    owners = assigned.groupBy("job_id").agg(F.collect_list(F.struct("face_id", "event_ord")).alias("_owners"))
    joined = join_facts(events.select(*EVENT, "event_ord"), owners, ["job_id"], ["event_id"], "left")
    earlier = F.filter(F.coalesce("_owners", F.array()), lambda o: o["event_ord"] < F.col("event_ord"))
    return joined.select(*EVENT, F.array_sort(F.transform(earlier, lambda o: o["face_id"])).alias("taken"))


def _by_number(faces: Column) -> Column:
    """Faces as (n, face), the highest number first."""
    return F.reverse(F.array_sort(F.transform(
        faces, lambda f: F.struct(F.element_at(F.split(f, "_"), F.lit(2)).cast("int").alias("n"), f.alias("face"))
    )))


def first_attempt(face: Column, preferred: Column, taken: Column) -> Column:
    """Number of the first attempt that admits a face, null if none does.

    A free face passes at once. A taken one passes where another single face is left out, which is the first single
    attempt unless it is that face itself; the only taken face passes when nothing is left out.
    """
    highest = F.get(_by_number(taken), F.lit(0))["face"]
    return (
        F.when(preferred != "", F.when(face == preferred, 0))
        .when(~F.array_contains(taken, face), 0)
        .when((F.size(taken) == 1) | (face != highest), 1)
        .otherwise(2)
    )


def exclusion_attempts(events: DataFrame) -> DataFrame:
    """Sets of faces to leave out, in the order tried (needs ``preferred_face`` and ``taken``).

    All taken faces, then each single one with the highest number first, then none. With a preferred
    face there is one attempt that leaves out nothing.
    """
    none = F.array().cast("array<string>")
    by_number = _by_number(F.col("taken"))
    singles = F.transform(by_number, lambda s: F.array(s["face"]))
    tries = F.array_distinct(F.concat(F.array(F.array_sort("taken")), singles, F.array(none)))
    attempts = F.when(F.col("preferred_face") != "", F.array(none)).otherwise(tries)
    return events.select("*", F.posexplode(attempts).alias("attempt", "excluded"))


def choose_capture(events: DataFrame, captures: DataFrame, cluster_pictures: DataFrame) -> DataFrame:
    """The picture of each event (needs ``preferred_face``, ``taken`` and ``allow_fallback``).

    The first attempt with a match, at its first offset; else the preferred face's cluster picture if
    allowed; else nothing. ``cluster_pictures`` lists (job_id, face_id) with a stored picture.
    """
    asked = captures.join(events.select(*EVENT, "preferred_face", "taken"), EVENT)
    attempt = first_attempt(F.col("face_id"), F.col("preferred_face"), F.col("taken"))
    matches = asked.withColumn("attempt", attempt).filter("attempt IS NOT NULL")
    order = F.struct(F.col("attempt"), F.col("offset_rank"), -F.col("score"), F.col("obs_id"))
    found = matches.groupBy(*EVENT).agg(
        F.min_by(F.struct("face_id", "frame_ts", "obs_id"), order).alias("_found")
    )
    pictures = cluster_pictures.select("job_id", F.col("face_id").alias("preferred_face"), F.lit(True).alias("_stored")).distinct()
    joined = join_facts(events.join(found, EVENT, "left"), pictures, ["job_id", "preferred_face"], ["event_id"], "left")
    stands_in = F.col("allow_fallback") & (F.col("preferred_face") != "") & F.coalesce("_stored", F.lit(False))
    return joined.select(
        *EVENT,
        F.coalesce(F.col("_found.face_id"), F.when(stands_in, F.col("preferred_face")), F.lit("")).alias("capture_face"),
        F.col("_found.frame_ts").alias("capture_ts"), F.col("_found.obs_id").alias("capture_obs"),
        F.when(F.col("_found").isNotNull(), "frame").when(stands_in, "cluster").otherwise("none").alias("capture_source"),
    )


def face_labels(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """(job_id, face_id, name) with the name as it was heard."""
    return assigned.select(*EVENT, "face_id").join(events.select(*EVENT, "name"), EVENT).select("job_id", "face_id", "name")


def detection_records(events: DataFrame, assigned: DataFrame, base: str = "transcript") -> DataFrame:
    """A10: one detection per event with its face, clip label and picture path, then enriched."""
    faces = assigned.select(*EVENT, "face_id", "lip_score")
    label = clip_label(F.col("source_video"))
    picture = artifact_name(F.col("name"), F.col("timestamp"), label, ".jpg", "name")
    rows = events.join(faces, EVENT, "left").withColumns({
        "face_id": F.coalesce("face_id", F.lit("")),
        "lip_score": F.coalesce("lip_score", F.lit(0.0)),
        "clip_label": label,
        "thumbnail_file": F.concat(F.lit("name_intro_thumbnails/"), picture),
    })
    return enrich_detections(rows, base)


def _usable_paths(thumbnails: DataFrame) -> DataFrame:
    return thumbnails.select(
        "job_id", F.col("path").alias("thumbnail_file"),
        usable_thumbnail(F.col("width"), F.col("height"), F.col("brightness")).alias("_usable"),
    )


def display_thumbnails(rows: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """The intro picture if usable, else the face's cluster picture if stored, else the intro path."""
    stored = thumbnails.select("job_id", F.col("path").alias("_cluster_path"), F.lit(True).alias("_stored")).distinct()
    cluster_path = F.when(F.col("face_id") != "", F.concat(F.lit("face_thumbnails/"), "face_id", F.lit(".jpg")))
    joined = rows.withColumn("_cluster_path", cluster_path).join(
        _usable_paths(thumbnails), ["job_id", "thumbnail_file"], "left"
    ).join(stored, ["job_id", "_cluster_path"], "left")
    return joined.withColumn(
        "display_path",
        F.when(F.coalesce("_usable", F.lit(False)), F.col("thumbnail_file"))
        .when(F.coalesce("_stored", F.lit(False)), F.col("_cluster_path"))
        .otherwise(F.col("thumbnail_file")),
    ).drop("_usable", "_stored", "_cluster_path")


def refresh_thumbnails(
    detections: DataFrame, thumbnails: DataFrame, captures: DataFrame, cluster_pictures: DataFrame
) -> DataFrame:
    """A new capture for detections whose picture is not usable, with the stored face preferred."""
    usable = _usable_paths(thumbnails).filter("_usable")
    stale = detections.join(usable, ["job_id", "thumbnail_file"], "left_anti").select(
        *EVENT, F.coalesce("face_id", F.lit("")).alias("preferred_face"), F.array().cast("array<string>").alias("taken"),
        ((F.coalesce("lip_score", F.lit(0.0)) <= 0) | (F.coalesce("face_id", F.lit("")) != "face_0")).alias("allow_fallback"),
    )
    return choose_capture(stale, captures, cluster_pictures)
