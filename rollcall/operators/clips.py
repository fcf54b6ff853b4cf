"""Introduction clip planning: the edit decisions, without any encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.scalars import artifact_name
from rollcall.operators.joins import interval_join, join_facts
from rollcall.operators.sampling import bright_frames
from rollcall.session import cut_lineage

# Fixed values of the clip rules, in seconds.
PRE_ROLL = 4.0
MIN_LENGTH, MAX_LENGTH = 24.0, 48.0
AFTER_EVENT, AFTER_WIDE = 18.0, 12.0
SEARCH_BEFORE, SEARCH_AHEAD = 10.0, 150.0
WIDE_LENGTH, WIDE_PRE_ROLL, TAIL_MARGIN = 14.0, 3.0, 5.0
LAG_LIMIT = 8.0
REALIGNED_SPAN, REALIGNED_AUDIO_LENGTH = 30.0, 14.0
REALIGNED_VIDEO_PRE_ROLL, REALIGNED_AUDIO_PRE_ROLL = 3.0, 2.0
SEARCH_OFFSETS = [
    0.0, 0.5, 1.0, -1.0, 2.0, -2.0, 3.0, -3.0, 5.0, -5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0,
]

#: Seconds of a slot that events and bright seconds meet in, and how far a search looks back and ahead of it at most.
SEARCH_SLOT = 128.0
SEARCH_BACK, SEARCH_REACH = 2.0 - min(SEARCH_OFFSETS), 1.0 + max(SEARCH_OFFSETS)

EVENT = ["job_id", "event_id"]
#: Largest blocks of the maxima table hold 2 ** TOP_LEVEL seconds.
TOP_LEVEL = 8


def presence(observations: DataFrame) -> DataFrame:
    """I1 for whole jobs: per half-even second and face, the first and last time it was seen there."""
    return observations.filter(F.col("cluster_id") != "").groupBy(
        "job_id", F.bround("timestamp").alias("second"), "cluster_id"
    ).agg(F.min("timestamp").alias("seen_from"), F.max("timestamp").alias("seen_to"))


def presence_counts(presence_table: DataFrame) -> DataFrame:
    """Distinct faces per second."""
    return presence_table.groupBy("job_id", "second").agg(F.count(F.lit(1)).alias("faces"))


def presence_in(presence_table: DataFrame, windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """I1 inside a closed window per event: distinct faces per second of the window.

    Works on the per-second table, not on observations. A window of two seconds or more cuts a second
    at one side only, so first and last sighting decide whether a face of that second is inside.
    """
    spans = windows.select(
        *EVENT, start.alias("_from"), end.alias("_to"), (start - 1).alias("_lo"), (end + 1).alias("_hi")
    )
    pairs = interval_join(presence_table, spans, ["job_id"], "second", "_lo", "_hi", 64.0, spread=["second", "cluster_id"])
    inside = pairs.filter((F.col("seen_to") >= F.col("_from")) & (F.col("seen_from") <= F.col("_to")))
    return inside.groupBy(*EVENT, "second").agg(F.count(F.lit(1)).alias("faces"))


def global_wide_shot(counts: DataFrame) -> DataFrame:
    """The second with most faces in a job, the latest on ties."""
    return counts.groupBy("job_id").agg(F.max(F.struct("faces", "second")).alias("_wide")).select(
        "job_id", F.col("_wide.second").alias("wide_second"), F.col("_wide.faces").alias("wide_faces")
    )


def peak_in(counts: DataFrame) -> DataFrame:
    """I2 per event window: the second with most faces, the latest on ties."""
    return counts.groupBy(*EVENT).agg(F.max(F.struct("faces", "second")).alias("_peak")).select(
        *EVENT, F.col("_peak.second").alias("peak_second"), F.col("_peak.faces").alias("peak_faces")
    )


def presence_blocks(counts: DataFrame, cluster_counts: DataFrame | None = None) -> DataFrame:
    """Maxima of aligned blocks of 1, 2, 4, ... seconds of a job, as many rows as two per second.

    Per block: the most faces and the latest second with them, the same with the earliest second, and the first second that
    shows the whole cast (null without one, or where the job's clusters are unknown).
    """
    cast = counts.withColumn("clusters", F.lit(None).cast("long"))
    if cluster_counts is not None:
        cast = join_facts(counts, cluster_counts.select("job_id", "clusters"), ["job_id"], spread=["second"], how="left")
    level = F.explode(F.sequence(F.lit(0), F.lit(TOP_LEVEL))).alias("level")
    second = F.col("second")
    return cast.select("*", level).groupBy(
        "job_id", "level", F.expr("CAST(floor(second / shiftleft(1L, level)) AS BIGINT)").alias("block")
    ).agg(
        F.max(F.struct("faces", "second")).alias("latest"), F.max(F.struct("faces", (-second).alias("back"))).alias("earliest"),
        F.min(F.when((F.col("clusters") > 0) & (F.col("faces") >= F.col("clusters")), second)).alias("full"),
    )


def _blocks_between(spans: DataFrame, first: str, end: str) -> DataFrame:
    """Spans once per aligned block (level, block) of the whole seconds from ``first`` on and before ``end``.

    At each size one block that lies inside on the left and one on the right, and at the largest size all between.
    """
    sized = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP_LEVEL)))).selectExpr(
        "*", f"CAST(ceil({first} / shiftleft(1L, level)) AS BIGINT) AS _left", f"CAST(floor({end} / shiftleft(1L, level)) AS BIGINT) AS _right"
    ).filter("_left < _right")
    here = F.expr(f"""CASE WHEN level = {TOP_LEVEL} THEN sequence(_left, _right - 1)
        ELSE filter(array(if(_left % 2 = 0, NULL, _left), if(_right % 2 = 0, NULL, _right - 1)), b -> b IS NOT NULL) END""")
    return sized.withColumn("block", F.explode(here)).drop("_left", "_right")


def window_peaks(windows: DataFrame, presence_table: DataFrame, blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """I1, I2 of a closed window per event: ``latest``, ``earliest`` and ``full`` as in ``presence_blocks``.

    The whole seconds of a window are a few aligned blocks, two per size at most. Only the second that holds the window's
    start and the one that holds its end are cut; the faces of these two are counted by first and last sighting.
    ``windows`` needs ``clusters``, the job's number of faces or null. Events that see nobody have no row.
    """
    spans = windows.select(*EVENT, "clusters", start.alias("_from"), end.alias("_to")).withColumns({
        "_low": F.bround("_from"), "_high": F.bround("_to"),
    })
    edges = spans.select(*EVENT, "clusters", "_from", "_to", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("second"))
    cut = edges.join(presence_table, ["job_id", "second"]).filter((F.col("seen_to") >= F.col("_from")) & (F.col("seen_from") <= F.col("_to")))
    second = F.col("second")
    at_edges = cut.groupBy(*EVENT, "clusters", "second").agg(F.count(F.lit(1)).alias("faces")).select(
        *EVENT, F.struct("faces", "second").alias("latest"), F.struct("faces", (-second).alias("back")).alias("earliest"),
        F.when((F.col("clusters") > 0) & (F.col("faces") >= F.col("clusters")), second).alias("full"),
    )
    whole = _blocks_between(spans.selectExpr(*EVENT, "_low + 1 AS _first", "_high"), "_first", "_high")
    inside = whole.join(blocks, ["job_id", "level", "block"]).select(*EVENT, "latest", "earliest", "full")
    return at_edges.unionByName(inside).groupBy(*EVENT).agg(
        F.max("latest").alias("latest"), F.max("earliest").alias("earliest"), F.min("full").alias("full")
    )


def clip_windows(events: DataFrame, presence_table: DataFrame, cluster_counts: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """I4: start and length of each event's clip; ``blocks`` may give the ``presence_blocks`` of the table.

    The clip should reach the first second with the whole cast in view, if the search window ever shows
    it, and otherwise the second with most faces.
    """
    at = F.col("timestamp")
    blocks = presence_blocks(presence_counts(presence_table), cluster_counts) if blocks is None else blocks
    cast = join_facts(events, cluster_counts.select("job_id", "clusters"), ["job_id"], spread=["event_id"], how="left")
    found = window_peaks(cast, presence_table, blocks, F.greatest(at - SEARCH_BEFORE, F.lit(0.0)), at + SEARCH_AHEAD)
    first_peak = F.when(F.coalesce("clusters", F.lit(0)) == 0, -F.col("earliest.back"))
    best = F.coalesce("full", first_peak, F.col("latest.second"), F.lit(0.0))
    start = F.greatest(at - PRE_ROLL, F.lit(0.0))
    length = F.greatest(at + AFTER_EVENT, best + AFTER_WIDE) - start
    return cast.join(found, EVENT, "left").select(
        *events.columns, start.alias("clip_start"),
        F.least(F.lit(MAX_LENGTH), F.greatest(F.lit(MIN_LENGTH), length)).alias("clip_length"),
    )


def primary_peaks(planned: DataFrame, presence_table: DataFrame, start: str, length: str, out: str, blocks: DataFrame | None = None) -> DataFrame:
    """Most faces in one second of the planned span; 0 when nobody is seen."""
    blocks = presence_blocks(presence_counts(presence_table)) if blocks is None else blocks
    spans = planned.withColumn("clusters", F.lit(None).cast("long"))
    found = window_peaks(spans, presence_table, blocks, F.col(start), F.col(start) + F.col(length))
    peaks = found.select(*EVENT, F.col("latest.faces").alias(out))
    return planned.join(peaks, EVENT, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def add_wide_tail(planned: DataFrame, wide: DataFrame, start: str, length: str, peak: str) -> DataFrame:
    """Whether a shot of the whole cast is appended, from where, and the faces then visible."""
    joined = join_facts(planned, wide, ["job_id"], spread=["event_id"], how="left")
    faces = F.coalesce("wide_faces", F.lit(0))
    needed = (
        (faces > 0) & (faces > F.col(peak))
        & (F.coalesce("wide_second", F.lit(0.0)) > F.col(start) + F.col(length) - TAIL_MARGIN)
    )
    return joined.withColumn("includes_full_cast", needed).withColumns({
        "faces_visible": F.when(needed, F.greatest(F.col(peak), faces)).otherwise(F.col(peak)),
        "tail_start": F.when(needed, F.greatest(F.col("wide_second") - WIDE_PRE_ROLL, F.lit(0.0))),
        "tail_length": F.when(needed, F.lit(WIDE_LENGTH)),
    }).drop("wide_second", "wide_faces")


def second_timeline(frames: DataFrame, tolerance_s: float = 0.5) -> DataFrame:
    """One frame per whole second of a clip: the sampled frame nearest to it."""
    second = F.bround("timestamp")
    gap = F.abs(F.col("timestamp") - second)
    return frames.filter(gap <= tolerance_s).groupBy("job_id", "source_video", second.alias("second")).agg(
        F.min_by("brightness", F.struct(gap, F.col("timestamp"))).alias("brightness")
    )


def _search_stages() -> list[tuple[int, float, float]]:
    """(stage, from, to) relative to the event. A stage going backwards covers no second and is left out."""
    ends = [0.0, *SEARCH_OFFSETS]
    return [(n, low, high) for n, (low, high) in enumerate(zip(ends, SEARCH_OFFSETS)) if high >= low]


def first_visible(events: DataFrame, frames: DataFrame) -> DataFrame:
    """The first bright second, searched in stages that widen around the event.

    A stage runs from the previous offset to its own, so the stage after a negative offset looks back a little. Each
    stage asks for the next bright second from its start on; the first stage whose answer lies inside it settles the event.
    The answers are listed per clip and time slot, one for each whole second that a search of the slot may start from, so
    an event meets one row and looks its answers up by place; no list is longer than two slots.
    """
    at, second, slot = F.col("timestamp"), F.col("second"), F.col("_slot")
    first = slot * SEARCH_SLOT - SEARCH_BACK
    slots = F.sequence(F.floor((second - SEARCH_REACH) / SEARCH_SLOT), F.floor((second + SEARCH_BACK) / SEARCH_SLOT))
    seconds = bright_frames(frames).filter(second.isNotNull()).select("job_id", "source_video", "second").distinct()
    listed = seconds.withColumn("_slot", F.explode(slots)).groupBy("job_id", "source_video", "_slot").agg(F.sort_array(F.collect_list("second")).alias("_at"))
    before = F.concat(F.array(first - 1), F.slice("_at", 1, F.size("_at") - 1))
    answers = F.flatten(F.zip_with("_at", before, lambda s, b: F.array_repeat(s, (F.floor(s) - F.floor(b)).cast("int"))))
    near = listed.select("job_id", "source_video", "_slot", answers.alias("_next"))
    met = join_facts(events.withColumn("_slot", F.floor(at / SEARCH_SLOT)), near, ["job_id", "source_video", "_slot"], ["event_id"], "left")
    settled = []
    for _, low, high in _search_stages():
        start, end = F.floor(F.greatest(at + low, F.lit(0.0))).cast("double"), (at + high).cast("long").cast("double")
        after = F.get("_next", (start - first).cast("int"))
        settled.append(F.when(after <= end, after))
    return met.select(*events.columns, F.coalesce(*settled).alias("visible_s"))


def needs_realign(visible: Column, timestamp: Column, face_id: Column, lip_score: Column) -> Column:
    """I8: the picture comes much later than the voice and no face was seen speaking."""
    late = F.coalesce(visible > timestamp + LAG_LIMIT, F.lit(False))
    seen_speaking = (F.coalesce(face_id, F.lit("")) != "") & (F.coalesce(lip_score, F.lit(0.0)) > 0)
    return late & ~seen_speaking


def realigned_plan(events: DataFrame) -> DataFrame:
    """Separate start times for sound and picture, from ``visible_s``."""
    realign = F.col("audio_realigned")
    return events.withColumns({
        "audio_start": F.when(realign, F.greatest(F.col("timestamp") - REALIGNED_AUDIO_PRE_ROLL, F.lit(0.0))),
        "video_start": F.when(realign, F.greatest(F.col("visible_s") - REALIGNED_VIDEO_PRE_ROLL, F.lit(0.0))),
        "realigned_length": F.when(realign, F.lit(min(REALIGNED_SPAN, REALIGNED_AUDIO_LENGTH))),
    })


def clamp_to_media(start: Column, length: Column, duration: Column) -> tuple[Column, Column]:
    """Start at most one second before the end, length within what is left; unknown duration changes nothing."""
    known = F.coalesce(duration, F.lit(0.0)) > 0
    inside = F.when(known, F.least(start, F.greatest(duration - 1.0, F.lit(0.0)))).otherwise(start)
    fitted = F.when(known, F.least(length, F.greatest(duration - inside, F.lit(1.0)))).otherwise(length)
    return inside, fitted


def plan_intro_clips(
    events: DataFrame, observations: DataFrame, frames: DataFrame, clips: DataFrame, cluster_counts: DataFrame
) -> DataFrame:
    """One clip record per event. A clip missing from ``clips`` falls back to the job's main clip.

    ``events`` holds event_id, name, timestamp, source_video, clip_label, face_id and lip_score.
    """
    seen = cut_lineage(presence(observations))
    counts = presence_counts(seen)
    wide, blocks = global_wide_shot(counts), cut_lineage(presence_blocks(counts, cluster_counts))
    known = clips.select("job_id", "source_video", F.col("duration_s").alias("_duration"))
    main = clips.filter("is_main").select(
        "job_id", F.col("source_video").alias("_main"), F.col("duration_s").alias("_main_duration")
    )
    sourced = join_facts(events, known.withColumn("_found", F.lit(True)), ["job_id", "source_video"], ["event_id"], "left")
    sourced = join_facts(sourced, main, ["job_id"], ["event_id"], "left").withColumns({
        "source_video": F.when(F.col("_found"), F.col("source_video")).otherwise(F.col("_main")),
        "duration_s": F.when(F.col("_found"), F.col("_duration")).otherwise(F.col("_main_duration")),
    }).drop("_found", "_main", "_duration", "_main_duration")

    visible = first_visible(clip_windows(sourced, seen, cluster_counts, blocks), frames)
    realign = needs_realign(F.col("visible_s"), F.col("timestamp"), F.col("face_id"), F.col("lip_score"))
    planned = cut_lineage(realigned_plan(visible.withColumn("audio_realigned", realign)).withColumns({
        "_start": F.coalesce("video_start", "clip_start"),
        "_length": F.when(F.col("audio_realigned"), F.lit(REALIGNED_SPAN)).otherwise(F.col("clip_length")),
    }))
    tailed = add_wide_tail(primary_peaks(planned, seen, "_start", "_length", "_peak", blocks), wide, "_start", "_length", "_peak")
    encode_length = F.when(F.col("audio_realigned"), F.col("realigned_length")).otherwise(F.col("clip_length"))
    start, length = clamp_to_media(F.col("_start"), encode_length, F.col("duration_s"))
    audio_start, _ = clamp_to_media(F.col("audio_start"), F.lit(REALIGNED_AUDIO_LENGTH), F.col("duration_s"))
    tail_start, tail_length = clamp_to_media(F.col("tail_start"), F.col("tail_length"), F.col("duration_s"))
    missing = F.col("source_video").isNull()
    tailed_too = ~missing & F.col("tail_start").isNotNull()
    file_name = artifact_name(F.col("name"), F.col("timestamp"), F.col("clip_label"), ".mp4", "intro")
    return tailed.select(
        *EVENT, "name", "timestamp", "source_video",
        F.when(missing, "").otherwise(F.concat(F.lit("intro_clips/"), file_name)).alias("intro_clip_file"),
        F.when(~missing, F.round("clip_start", 2)).alias("intro_clip_start"),
        F.when(~missing, F.round("clip_length", 2)).alias("intro_clip_duration"),
        F.when(missing, 0).otherwise(F.col("faces_visible")).cast("long").alias("intro_clip_faces_visible"),
        (~missing & F.col("includes_full_cast")).alias("intro_clip_includes_full_cast"),
        (~missing & F.col("audio_realigned")).alias("intro_clip_audio_realigned"),
        F.when(~missing, start).alias("encode_start"), F.when(~missing, length).alias("encode_length"),
        F.when(~missing & F.col("audio_realigned"), audio_start).alias("audio_start"),
        F.when(tailed_too, tail_start).alias("tail_start"), F.when(tailed_too, tail_length).alias("tail_length"),
    )
