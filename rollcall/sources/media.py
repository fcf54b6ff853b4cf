"""Clip listings, manifests and picture statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.ordered import number_rows, number_sorted
from rollcall.operators.sampling import VIDEO_SUFFIXES, path_suffix


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes under a folder; the content column is pruned, so no file is read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")


def video_files(listing: DataFrame) -> DataFrame:
    """Files with a video suffix in any case."""
    return listing.filter(path_suffix(F.col("path")).isin(*VIDEO_SUFFIXES))


def number_clips(listing: DataFrame) -> DataFrame:
    """clip_idx in path order per job, from 0."""
    return number_sorted(listing, ["job_id"], ["path"], "clip_idx").withColumn("clip_idx", F.col("clip_idx").cast("int"))


def clip_manifest(main: DataFrame, extras: DataFrame) -> DataFrame:
    """Main clip first, then the extras in ``ord`` order without the main clip and without repeats."""
    others = extras.join(main.select("job_id", "source_video"), ["job_id", "source_video"], "left_anti")
    firsts = others.groupBy("job_id", "source_video").agg(F.min("ord").alias("ord"))
    numbered = number_rows(firsts, ["job_id"], "ord", "clip_idx", first=1)
    first = main.select("job_id", "source_video", F.lit(True).alias("is_main"), F.lit(0).alias("clip_idx"))
    return first.unionByName(numbered.select(
        "job_id", "source_video", F.lit(False).alias("is_main"), F.col("clip_idx").cast("int").alias("clip_idx")
    ))


def clip_paths(jobs: DataFrame, manifests: DataFrame, faces: DataFrame) -> DataFrame:
    """S3: the manifest's clips, else the sampled clips if there are any, else the main clip.

    ``jobs`` (job_id, main_video), ``manifests`` (job_id, all_clips), ``faces`` (job_id, sampled_videos).
    """
    joined = jobs.join(manifests.select("job_id", "all_clips"), "job_id", "left").join(
        faces.select("job_id", "sampled_videos"), "job_id", "left"
    )
    sampled = F.when(F.size("sampled_videos") > 0, F.col("sampled_videos"))
    paths = F.coalesce("all_clips", sampled, F.array("main_video"))
    return joined.select("job_id", F.posexplode(paths).alias("clip_idx", "source_video"))


def picture_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Size and mean brightness of the pictures under a folder; unreadable files are dropped.

    The byte sum runs inside Arrow batches: a picture's bytes never become one row per pixel.
    """
    pictures = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    def measure(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            values = [
                float(np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)[:, :3].mean())
                for data, channels in zip(batch["data"], batch["nChannels"])
            ]
            yield pd.DataFrame({
                "path": batch["origin"], "width": batch["width"], "height": batch["height"], "brightness": values,
            })

    return pictures.mapInPandas(measure, "path string, width int, height int, brightness double")
