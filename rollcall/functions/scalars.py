"""Timecodes and file-name text."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_timecode(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``; the seconds part is rounded on its own and never carries."""
    hours = F.floor(seconds / 3600).cast("long")
    minutes = F.floor((seconds % 3600) / 60).cast("long")
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, F.round(seconds % 60, 3))


def short_timecode(seconds: Column) -> Column:
    """whole seconds (half-even), as ``M:SS`` or ``H:MM:SS``."""
    total = F.greatest(F.bround(seconds).cast("long"), F.lit(0).cast("long"))
    hours, minutes, rest = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    with_hours = F.format_string("%d:%02d:%02d", hours, minutes, rest)
    return F.when(hours > 0, with_hours).otherwise(F.format_string("%d:%02d", minutes, rest))


#: What ``[^A-Za-z0-9._-]+`` matches, its characters listed one by one: Java looks these up in a table, ranges it tests in turn.
UNSAFE = f"[^{ascii_letters}{digits}._\\-]+"


def safe_stem(text: Column, default: str) -> Column:
    """characters outside ``[A-Za-z0-9._-]`` become one underscore; dots and underscores are trimmed off."""
    cleaned = F.btrim(F.regexp_replace(text, UNSAFE, "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def clip_label(path: Column) -> Column:
    """last path part without its final suffix; a leading dot does not start a suffix."""
    base = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.when(base.rlike("^.+\\.[^.]+$"), F.regexp_extract(base, "^(.+)\\.[^.]+$", 1)).otherwise(base)


def artifact_name(name: Column, timestamp: Column, label: Column, suffix: str, default_name: str) -> Column:
    """``<name>_<whole second>_<clip><suffix>`` from safe parts."""
    return F.concat(
        F.concat_ws("_", safe_stem(name, default_name), timestamp.cast("long").cast("string"), safe_stem(label, "clip")),
        F.lit(suffix),
    )
