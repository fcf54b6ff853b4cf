"""Input tables for the registered queries, derived by plain SQL from the given parquet tables.

The same text runs in Spark and in DuckDB, so each oracle puts the views it needs in front as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.ordered import number_rows

# Events numbered within their day. Spark numbers them chunk by chunk instead of in one window per day.
NUMBERED = "(SELECT *, day(ts) AS d, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) - 1 AS i FROM events)"

VIEWS = {
    "obs_v": """
SELECT 'job_' || CAST(day(e.ts) AS STRING) AS job_id, e.event_id AS obs_id,
  'clip_' || CAST(e.event_id % 2 AS STRING) AS source_video,
  CAST(floor((hour(e.ts) * 3600 + minute(e.ts) * 60 + second(e.ts)) / 400.0) AS DOUBLE) / 2 AS ts_s,
  (e.user_id % 5) * 380 + e.event_id % 7 AS x1, 300 + e.event_id % 5 AS y1,
  (e.user_id % 5) * 380 + e.event_id % 7 + 180 AS x2, 520 + e.event_id % 5 AS y2,
  m.embedding AS embedding, e.value / 10000 AS lip_openness,
  CASE WHEN e.event_id % 11 = 0 THEN '' ELSE 'face_' || CAST(e.user_id % 5 AS STRING) END AS cluster_id
FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS v FROM events) e JOIN embeddings m ON m.vec_id = e.v
""",
    "seg_v": """
SELECT 'job_' || CAST(d AS STRING) AS job_id, i AS seg_idx,
  'speaker_' || CAST((i * 7 + d) % 3 AS STRING) AS speaker_id,
  CAST(i AS DOUBLE) * 2.5E0 AS start_s, CAST(i AS DOUBLE) * 2.5E0 + 2.0E0 AS end_s
FROM (SELECT DISTINCT day(ts) AS d, event_id % 60 AS i FROM events) q
""",
    "label_v": """
SELECT 'job_' || CAST(q.d AS STRING) AS job_id, 'face_' || CAST(n.n_nationkey AS STRING) AS face_id,
  CASE WHEN n.n_nationkey = 3 THEN '' ELSE n.n_name END AS name
FROM (SELECT DISTINCT day(ts) AS d, event_id % 25 AS k FROM events) q JOIN nation n ON n.n_nationkey = q.k
""",
    "voice_v": f"""
SELECT 'job_' || CAST(d AS STRING) AS job_id, i AS win_idx, 0.75E0 * (i + 1) AS ts_s,
  CASE WHEN i % 13 = 5 THEN 2 ELSE CAST(floor(i / (3.0 + d % 3)) AS INT) % 3 END AS label, vec_id
FROM (SELECT d, event_id % (SELECT count(*) FROM embeddings) AS vec_id, i FROM {NUMBERED} e) q
""",
    "frame_v": f"""
SELECT 'job_' || CAST(d AS STRING) AS job_id, i AS frame_idx, 25.0E0 AS native_fps,
  i / 25.0E0 AS ts_s, CAST(i AS DOUBLE) AS second_s, value % 60 AS brightness
FROM (SELECT d, value, i FROM {NUMBERED} e) q
""",
    "text_v": """
SELECT 'conv_' || CAST(c.conv_id AS STRING) AS job_id, c.turn AS seg_idx, c.role AS source_video,
  c.turn * 7.5E0 AS start_s, c.turn * 7.5E0 + 7.0E0 AS end_s,
  CASE (c.turn + c.conv_id) % 8
    WHEN 0 THEN 'Hi, I''m ' || split_part(p.p_name, ' ', 1) || ' and I''m from ' || r.r_name || '.'
    WHEN 1 THEN 'My name is ' || p.p_name || '. ' || c.text
    WHEN 2 THEN 'It is C-O-R-Y with a K, pronounced as ' || split_part(p.p_name, ' ', 1) || '. ' || c.text
    WHEN 3 THEN c.text
    WHEN 4 THEN 'This is ' || split_part(p.p_name, ' ', 2) || '. Call me ' || split_part(p.p_name, ' ', 1) || '. ' || c.text
    WHEN 5 THEN split_part(p.p_name, ' ', 1) || ' and I''m from the coast but raised inland. ' || c.text
    WHEN 6 THEN 'I''m ' || split_part(p.p_name, ' ', 1) || ' and I''m very glad. ' || c.text
    ELSE 'So here we are. ' || c.text END AS text
FROM (SELECT *, (conv_id * 7 + turn) % (SELECT count(*) FROM part) AS v FROM conversations) c JOIN part p ON p.p_partkey = c.v
JOIN region r ON r.r_regionkey = c.conv_id % 5
""",
    "event_v": """
SELECT 'job_' || CAST(day(e.ts) AS STRING) AS job_id, e.event_id AS event_id,
  split_part(p.p_name, ' ', 1) AS name, 'clip_' || CAST(e.event_id % 2 AS STRING) AS source_video,
  CAST(e.event_id % 100 AS DOUBLE) + 0.35E0 AS ts_s, 25.0E0 + e.user_id % 4 * 5 AS confidence,
  CASE WHEN e.event_id % 3 = 0 THEN '' ELSE 'face_' || CAST(e.user_id % 5 AS STRING) END AS face_id,
  CASE WHEN e.event_id % 4 = 0 THEN 0.0E0 ELSE e.value END AS lip_score
FROM (SELECT *, (user_id * 13 + event_id) % (SELECT count(*) FROM part) AS v FROM events) e JOIN part p ON p.p_partkey = e.v
""",
}

TABLES = ["region", "nation", "part", "events", "embeddings", "conversations", "documents", "pages", "customer", "supplier"]

BOX = "named_struct('x1', CAST(x1 AS INT), 'y1', CAST(y1 AS INT), 'x2', CAST(x2 AS INT), 'y2', CAST(y2 AS INT)) AS bbox"

# How each view's columns read in the engine's own table layout.
SHAPES = {
    "obs_v": f"job_id, obs_id, source_video, ts_s AS timestamp, {BOX}, embedding, lip_openness, cluster_id",
    "seg_v": "job_id, seg_idx, speaker_id, start_s AS start, end_s AS end",
    "label_v": "job_id, face_id, name",
    "voice_v": "job_id, CAST(win_idx AS INT) AS win_idx, ts_s AS timestamp, label, vec_id",
    "frame_v": "job_id, CAST(frame_idx AS BIGINT) AS frame_idx, native_fps, ts_s AS timestamp, second_s, brightness",
    "text_v": "job_id, seg_idx, source_video, start_s AS start, end_s AS end, text",
    "event_v": "job_id, event_id, name, source_video, ts_s AS timestamp, confidence, face_id, lip_score",
}


class Tables:
    """The given parquet tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _register(self, text: str) -> None:
        """Opens the tables that a text names, and no others."""
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self.table(table).createOrReplaceTempView(table)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        self._register(text)
        return self.spark.sql(text)

    def raw(self, view: str) -> DataFrame:
        text = VIEWS[view]
        if NUMBERED in text:
            days = self.table("events").withColumn("d", F.dayofmonth("ts"))
            number_rows(days, ["d"], "event_id", "i", first=0).createOrReplaceTempView("numbered_events")
            text = text.replace(NUMBERED, "numbered_events")
        return self.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        view = f"{name}_v"
        if view not in VIEWS:
            raise AttributeError(name)
        return self.raw(view).selectExpr(*_split(SHAPES[view]))


def _split(shape: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(shape):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(shape[start:i].strip())
            start = i + 1
    return [*parts, shape[start:].strip()]


def with_views(*names: str, recursive: bool = False) -> str:
    """Opening of an oracle text: the named views as CTEs."""
    body = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
