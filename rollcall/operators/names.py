"""Name events and detection details from transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import text as tx
from rollcall.operators.joins import interval_join
from rollcall.operators.ordered import following
from rollcall.session import cut_lineage

# Fixed values of the event rules.
EVENT_DELAY_S = 0.35
EARLY_S, EARLY_BONUS = 120.0, 5.0
CONTEXT_BEFORE_S, CONTEXT_AFTER_S = 2.0, 12.0
NEXT_INTRO_GAP_S = 0.5
REPEAT_WINDOW_S = 90.0

CLIP = ["job_id", "source_video"]


def clean_segments(segments: DataFrame, limit: str | None = None) -> DataFrame:
    """Trimmed, non-empty transcript segments that start within the scan limit column.

    A clip whose length is unknown (null, zero or less) has no limit.
    """
    kept = segments.withColumn("text", tx.strip(F.col("text"))).filter(F.col("text") != "")
    if limit is None:
        return kept
    return kept.filter(F.col(limit).isNull() | (F.col(limit) <= 0) | (F.col("start") <= F.col(limit)))


def context_texts(segments: DataFrame, windows: DataFrame, on: list[str], ids: list[str], out: str) -> DataFrame:
    """For each window (``_from``, ``_to``) the distinct texts of segments starting in it, in time order.

    Repeats of a text inside a window collapse in the first, map-side combined aggregation.
    """
    points = segments.select(*on, F.col("seg_idx").alias("_seq"), F.col("start").alias("_start"), F.col("text").alias("_said"))
    pairs = interval_join(points, windows, on, "_start", "_from", "_to", 16.0, spread=["_seq"])
    keys = list(dict.fromkeys([*on, *ids]))
    first = pairs.groupBy(*keys, "_said").agg(F.min(F.struct("_start", "_seq")).alias("_first"))
    texts = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "_said"))).alias("_texts"))
    return texts.select(*keys, F.array_join(F.col("_texts._said"), " ").alias(out))


def name_events(segments: DataFrame) -> DataFrame:
    """One event per name heard in a segment, with its score and surrounding text.

    ``segments`` holds clip_idx, seg_idx, source_video, start and text; event_ord keeps list order.
    """
    heard = tx.with_spoken_names(segments).filter(F.size("spoken") > 0)
    timed = heard.withColumn("timestamp", F.col("start") + EVENT_DELAY_S)
    windows = timed.select(
        *CLIP, "seg_idx",
        (F.col("timestamp") - CONTEXT_BEFORE_S).alias("_from"), (F.col("timestamp") + CONTEXT_AFTER_S).alias("_to"),
    )
    context = context_texts(segments, windows, CLIP, ["seg_idx"], "context_transcript")
    bonus = F.when(F.col("timestamp") < EARLY_S, EARLY_BONUS).otherwise(0.0)
    return timed.join(context, [*CLIP, "seg_idx"], "left").select(
        *CLIP, "clip_idx", "seg_idx", "timestamp", F.col("text").alias("transcript"),
        F.coalesce("context_transcript", F.lit("")).alias("context_transcript"),
        F.posexplode("spoken").alias("name_idx", "_hit"), bonus.alias("_bonus"),
    ).select(
        *CLIP, F.struct("clip_idx", "seg_idx", "name_idx").alias("event_ord"),
        F.col("_hit.name").alias("name"), "timestamp", "transcript", "context_transcript",
        (F.col("_hit.score") + F.col("_bonus")).alias("confidence"),
    )


def keep_best_repeats(events: DataFrame, window_s: float = REPEAT_WINDOW_S) -> DataFrame:
    """Of events with one name in one clip, the higher score silences others within the window.

    An event goes only if a *kept* one is near, so this is a greedy choice by score, then list order.
    It runs in rounds over time cells one window wide. Two events in one cell always exclude each
    other, hence only the best of a cell can be kept; it is kept once no better undecided event of the
    two neighbouring cells is near. Work per round is linear in the undecided events, and neither a
    name nor a cell is ever gathered in one task.
    """
    group = [*CLIP, "_name"]
    ranked = events.withColumn("_name", F.lower("name")).withColumn(
        "_rank", F.struct((-F.col("confidence")).alias("low"), F.col("event_ord").alias("ord"))
    )
    open_events = cut_lineage(
        ranked.groupBy(*group, "timestamp").agg(F.min("_rank").alias("_rank"))
        .withColumn("_cell", F.floor(F.col("timestamp") / window_s))
    )
    kept_parts = []
    while not open_events.isEmpty():
        tops = open_events.groupBy(*group, "_cell").agg(
            F.min(F.struct(F.col("_rank").alias("rank"), F.col("timestamp").alias("at"))).alias("_top")
        )
        asked = tops.withColumn("_home", F.col("_cell")).withColumn(
            "_cell", F.explode(F.array(F.col("_home") - 1, F.col("_home") + 1))
        )
        beaten = (
            open_events.join(asked, [*group, "_cell"])
            .filter((F.abs(F.col("timestamp") - F.col("_top.at")) <= window_s) & (F.col("_rank") < F.col("_top.rank")))
            .select(*group, F.col("_home").alias("_cell"))
            .distinct()
        )
        kept = cut_lineage(
            tops.join(beaten, [*group, "_cell"], "left_anti")
            .select(*group, "_cell", F.col("_top.at").alias("_at"), F.col("_top.rank.ord").alias("event_ord"))
        )
        kept_parts.append(kept)
        silencers = kept.select(
            *[F.col(c).alias(f"k_{c}") for c in group], F.col("_at").alias("k_at"),
            F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("k_cell"),
        )
        same = [F.col(c) == F.col(f"k_{c}") for c in group]
        near = F.abs(F.col("timestamp") - F.col("k_at")) <= window_s
        open_events = cut_lineage(
            open_events.join(silencers, [*same, F.col("_cell") == F.col("k_cell"), near], "left_anti")
        )
    if not kept_parts:
        return events.limit(0)
    chosen = kept_parts[0]
    for part in kept_parts[1:]:
        chosen = chosen.unionByName(part)
    return events.join(chosen.select(*CLIP, "event_ord"), [*CLIP, "event_ord"], "left_semi")


def enrich_detections(detections: DataFrame, base: str = "transcript") -> DataFrame:
    """Details read from the transcript and its context.

    The name is the first one heard in the transcript, else the stored one. ``base="event"`` keeps the
    stored name instead, so two names in one sentence give two names.
    """
    if base == "event":
        named = detections.withColumn("_base", F.coalesce("name", F.lit("")))
    else:
        named = tx.with_spoken_names(detections, "transcript", "_spoken").withColumn(
            "_base", F.coalesce(F.get("_spoken", F.lit(0))["name"], "name", F.lit(""))
        ).drop("_spoken")
    earlier = F.col("name_heard") if "name_heard" in detections.columns else F.lit(None).cast("string")
    stored = named.withColumn("_earlier", earlier).drop(
        "name_heard", "location", "name_spelling", "spelling_note", "pronunciation"
    )
    return (
        tx.with_intro_details(stored, "transcript", "_base", "context_transcript")
        .withColumns({"name": F.col("display_name"), "name_heard": F.coalesce("name_heard", "_earlier")})
        .drop("display_name", "_base", "_earlier")
    )


def main_segments(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Segments of each job's main clip; ``clips`` has job_id, source_video and is_main."""
    return segments.join(clips.filter("is_main").select("job_id", "source_video"), CLIP, "left_semi")


def bounded_contexts(detections: DataFrame, segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Text of the main clip around each distinct detection time, ending half a second before the next detection."""
    times = detections.select("job_id", "timestamp").distinct()
    chunk = F.floor(F.col("timestamp") / 600.0)
    ahead = following(times, ["job_id"], "timestamp", chunk, "timestamp", "_next")
    end = F.col("timestamp") + CONTEXT_AFTER_S
    windows = ahead.select(
        "job_id", "timestamp", (F.col("timestamp") - CONTEXT_BEFORE_S).alias("_from"),
        F.least(end, F.col("_next") - NEXT_INTRO_GAP_S).alias("_to"),
    )
    return context_texts(main_segments(segments, clips), windows, ["job_id"], ["timestamp"], "context_transcript")


def refresh_details(detections: DataFrame, segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Bounded context, base name from the transcript, then the earlier heard name, then the name."""
    contexts = bounded_contexts(detections, segments, clips)
    stored = detections.drop("context_transcript").join(contexts, ["job_id", "timestamp"], "left")
    heard = F.nullif(F.coalesce("name_heard", F.lit("")), F.lit(""))
    return enrich_detections(
        stored.withColumns({
            "context_transcript": F.coalesce("context_transcript", F.lit("")),
            "name": F.coalesce(heard, "name"),
        })
    )
