"""Face clusters of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.operators.density import EPS, density_components
from rollcall.operators.joins import join_facts
from rollcall.operators.ordered import number_rows
from rollcall.operators.sampling import add_features
from rollcall.operators.vectors import centroids, nearest_cluster
from rollcall.operators.ward import ward_clusters
from rollcall.session import cut_lineage

NOISE = -1


def faces_per_timestamp(observations: DataFrame, count_mode: str = "timestamp") -> DataFrame:
    """Observations per exact time. ``distinct_frame`` also separates clips and sampling passes."""
    extra = [c for c in ("source_video", "pass") if c in observations.columns] if count_mode == "distinct_frame" else []
    return observations.groupBy("job_id", "timestamp", *extra).agg(F.count(F.lit(1)).alias("faces"))


def person_count(per_timestamp: DataFrame) -> DataFrame:
    """The fullest time of each job and the faces seen then; the earliest on ties."""
    return per_timestamp.groupBy("job_id").agg(
        F.max("faces").alias("people"), F.min_by("timestamp", F.struct(-F.col("faces"), F.col("timestamp"))).alias("full_ts")
    )


def frame_seeds(features: DataFrame, people: DataFrame) -> DataFrame:
    """C3 seeds: the distinct features of each job's fullest time, in the order they were seen."""
    at_full = join_facts(features, people, ["job_id"], spread=["obs_id"]).filter(
        (F.col("timestamp") == F.col("full_ts")) & (F.col("people") > 1)
    )
    distinct = at_full.groupBy("job_id", "feature").agg(F.min("obs_id").alias("first_obs"))
    order = W.partitionBy("job_id").orderBy("first_obs")
    return distinct.select(
        "job_id", (F.row_number().over(order) - 1).alias("label"), F.col("feature").alias("vector")
    )


def k_cluster_faces(features: DataFrame, people: DataFrame) -> DataFrame:
    """(job_id, obs_id, label) by Ward linkage with as many clusters as people; one cluster for one person."""
    several = people.filter("people > 1").select("job_id", F.col("people").alias("k"))
    points = features.select("job_id", F.col("obs_id").alias("point_id"), F.col("feature").alias("vector"))
    labelled = ward_clusters(points, several).withColumnRenamed("point_id", "obs_id")
    alone = features.join(people.filter("people <= 1"), "job_id", "left_semi").select(
        "job_id", "obs_id", F.lit(0).alias("label")
    )
    return labelled.unionByName(alone)


def k_cluster_voices(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """V3: (job_id, win_idx, label) by Ward linkage; ``counts`` has the number of speakers ``k`` of each job."""
    points = windows.select(
        "job_id", F.col("win_idx").cast("long").alias("point_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return ward_clusters(points, counts.select("job_id", "k")).withColumnRenamed("point_id", "win_idx")


def renumber(labels: DataFrame) -> DataFrame:
    """Labels 0, 1, ... per job by the smallest obs_id of each cluster; noise keeps its mark."""
    firsts = labels.filter(F.col("label") != NOISE).groupBy("job_id", "label").agg(F.min("obs_id").alias("_first"))
    numbers = number_rows(firsts, ["job_id"], "_first", "number", first=0).select("job_id", "label", "number")
    return join_facts(labels, numbers, ["job_id", "label"], spread=["obs_id"], how="left").select(
        "job_id", "obs_id", F.coalesce(F.col("number").cast("int"), F.lit(NOISE)).alias("label")
    )


def density_clusters(features: DataFrame, eps: float = EPS) -> DataFrame:
    """C4: (job_id, obs_id, label), -1 for points with nothing within eps."""
    comps = density_components(features.select(
        "job_id", F.col("obs_id").alias("point_id"), F.col("feature").alias("vector")
    ), eps)
    sizes = comps.groupBy("job_id", "comp").agg(F.count(F.lit(1)).alias("n"))
    marked = join_facts(comps, sizes, ["job_id", "comp"], spread=["point_id"]).select(
        "job_id", F.col("point_id").alias("obs_id"), F.when(F.col("n") > 1, F.col("comp")).otherwise(NOISE).alias("label")
    )
    return renumber(marked)


def choose_clustering(by_count: DataFrame, by_density: DataFrame, people: DataFrame) -> DataFrame:
    """Density labels only in jobs where they find more clusters than people."""
    found = by_density.filter(F.col("label") != NOISE).groupBy("job_id").agg(F.countDistinct("label").alias("found"))
    verdict = people.join(found, "job_id", "left").select(
        "job_id",
        ((F.col("people") > 1) & (F.coalesce("found", F.lit(0)) > F.col("people"))).alias("use_density"),
    )
    both = by_count.withColumnRenamed("label", "count_label").join(
        by_density.withColumnRenamed("label", "density_label"), ["job_id", "obs_id"]
    )
    return join_facts(both, verdict, ["job_id"], spread=["obs_id"]).select(
        "job_id", "obs_id",
        F.when(F.col("use_density"), F.col("density_label")).otherwise(F.col("count_label")).alias("label"),
    )


def cluster_id(label: Column) -> Column:
    """``face_<label>``, or "" for noise."""
    return F.when(label == NOISE, "").otherwise(F.concat(F.lit("face_"), label.cast("string")))


def assign_noise(observations: DataFrame) -> DataFrame:
    """Each noise row joins the cluster with the nearest mean embedding; means are taken beforehand.

    Adds ``was_noise``. Jobs with no cluster at all keep their noise.
    """
    table = centroids(observations)
    marked = observations.withColumn("was_noise", F.col("cluster_id") == "")
    moved = nearest_cluster(marked.filter("was_noise"), table).drop("distance")
    return marked.filter("NOT was_noise").unionByName(moved.select(*marked.columns))


def cluster_faces(observations: DataFrame, sizes: DataFrame, count_mode: str = "timestamp") -> DataFrame:
    """Observations with their cluster; also re-clusters stored ones."""
    plain = observations.drop("cluster_id", "was_noise")
    features = cut_lineage(add_features(plain, sizes).select("job_id", "obs_id", "timestamp", "feature"))
    people = cut_lineage(person_count(faces_per_timestamp(plain, count_mode)))
    by_count, by_density = cut_lineage(k_cluster_faces(features, people)), cut_lineage(density_clusters(features))
    labels = cut_lineage(renumber(choose_clustering(by_count, by_density, people)))
    named = plain.join(labels, ["job_id", "obs_id"]).withColumn("cluster_id", cluster_id(F.col("label"))).drop("label")
    return assign_noise(named)


def noise_counts(clustered: DataFrame) -> DataFrame:
    """Noise rows per job, counted before they were moved."""
    return clustered.groupBy("job_id").agg(F.count(F.when(F.col("was_noise"), 1)).alias("noise_count"))


def cluster_summary(observations: DataFrame) -> DataFrame:
    """C11: size, thumbnail and the box of the widest open mouth per cluster; the first row wins a tie."""
    noise_last = ~F.col("was_noise") if "was_noise" in observations.columns else F.lit(True)
    widest = F.max_by("bbox", F.struct(F.col("lip_openness"), noise_last, -F.col("obs_id")))
    return observations.filter(F.col("cluster_id") != "").groupBy("job_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("sample_count"), widest.alias("representative_bbox")
    ).withColumn("thumbnail_path", F.concat(F.lit("face_thumbnails/"), "cluster_id", F.lit(".jpg")))
