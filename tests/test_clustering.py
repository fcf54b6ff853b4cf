"""Density and k-means clusters against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import blocks, clustering, density, kmeans, vectors


def _components(points, eps):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(points)), 2):
        if np.linalg.norm(points[i] - points[j]) <= eps:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(points)):
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def _random_jobs(seed, spread):
    rng = np.random.default_rng(seed)
    return {
        f"job_{n}": np.concatenate([rng.normal(size=(60, 5)) * 0.25, rng.uniform(0, spread, size=(60, 3))], axis=1)
        for n in range(3)
    }


def _frame(spark, jobs, shuffle=False):
    rows = [(job, i, [float(v) for v in p]) for job, points in jobs.items() for i, p in enumerate(points)]
    if shuffle:
        random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "job_id string, point_id long, vector array<double>")


@pytest.mark.parametrize("seed,spread,leaders,rows,shuffle", [(1, 2.0, 8, 2048, False), (2, 5.0, 1, 7, True), (3, 1.2, 2, 5, True)])
def test_density_components_are_exact(spark, monkeypatch, seed, spread, leaders, rows, shuffle):
    """Few leaders and tiny blocks force repeated leader rounds and the full block comparison."""
    monkeypatch.setattr(density, "LEADERS_PER_CELL", leaders)
    monkeypatch.setattr(density, "COMPARE_ROWS", rows)
    jobs = _random_jobs(seed, spread)
    got = {}
    for r in density.density_components(_frame(spark, jobs, shuffle)).collect():
        got.setdefault((r.job_id, r.comp), set()).add(r.point_id)
    for job, points in jobs.items():
        assert {frozenset(g) for (j, _), g in got.items() if j == job} == _components(points, density.EPS)


@pytest.mark.parametrize("sent,held", [(1 << 22, 3), (0, 1 << 15)])
def test_components_are_the_same_however_points_meet_leaders(spark, monkeypatch, sent, held):
    """Leaders sent to every task, with few rows held at once, or points moved to them."""
    monkeypatch.setattr(density, "SENT", sent)
    monkeypatch.setattr(density, "HELD_ROWS", held)
    monkeypatch.setattr(density, "LEADERS_PER_CELL", 2)
    jobs = _random_jobs(4, 1.5)
    got = {}
    for r in density.density_components(_frame(spark, jobs, True).repartition(3)).collect():
        got.setdefault((r.job_id, r.comp), set()).add(r.point_id)
    for job, points in jobs.items():
        assert {frozenset(g) for (j, _), g in got.items() if j == job} == _components(points, density.EPS)


def test_no_table_of_all_vectors_is_written(spark, monkeypatch):
    """400 points, all within reach of their cell's leaders: only leaders' vectors are written."""
    written = []
    for name in ("cut_lineage", "stored"):
        def watched(df, plain=getattr(density, name)):
            out = plain(df)
            for column in {"vector", "leader_vector"} & set(out.columns):
                written.append(out.where(f"{column} IS NOT NULL").count())
            return out

        monkeypatch.setattr(density, name, watched)
    rows = [("a", i, [0.1 * (i % 5), 0.2, 0.3, 5.0 * (i % 3), 0.1, 0.1]) for i in range(400)]
    found = density.density_components(spark.createDataFrame(rows, "job_id string, point_id long, vector array<double>")).collect()
    assert len(found) == 400 and len({r.comp for r in found}) == 3
    assert sum(written) <= 2 * 3 * density.LEADERS_PER_CELL


def test_vectors_move_only_where_they_are_compared(spark, monkeypatch):
    """Three crowded cells, of which two neighbours hold different components, and one row for a null job."""
    cut, seen = density.cut_lineage, []

    def watched(df):
        out = cut(df)
        if {"comp", "vector"} <= set(out.columns):
            seen.append({r.point_id for r in out.collect()})
        return out

    monkeypatch.setattr(density, "cut_lineage", watched)
    near = {i: [0.01 * i, 0.1, 0.1] for i in range(10)} | {i: [0.9 + 0.001 * i, 0.1, 0.1] for i in range(10, 20)}
    points = near | {i: [30 + 0.01 * i, 0.1, 0.1] for i in range(20, 40)}
    rows = [("a", i, v) for i, v in points.items()] + [(None, 99, [0.0, 0.0, 0.0])]
    got = {}
    for r in density.density_components(spark.createDataFrame(rows, "job_id string, point_id long, vector array<double>")).collect():
        got.setdefault((r.job_id, r.comp), set()).add(r.point_id)
    assert sorted(map(sorted, got.values())) == [list(range(10)), list(range(10, 20)), list(range(20, 40))]
    assert seen == [set(near)]


def test_blocks_of_few_points_are_told_without_moving_them(spark):
    points = spark.range(40).selectExpr("CAST(id % 4 AS STRING) AS job_id", "id AS point_id", "array(1.0D) AS vector")
    assert "hashpartitioning" not in blocks.cut_blocks(points, ["job_id"])._jdf.queryExecution().executedPlan().toString()
    assert {r.block for r in blocks.cut_blocks(points, ["job_id"]).collect()} == {0}
    sizes = [r["count"] for r in blocks.cut_blocks(points, ["job_id"], 3).groupBy("job_id", "block").count().collect()]
    assert sum(sizes) == 40 and len(sizes) > 8


def test_density_labels_are_numbered_by_first_observation(spark):
    rows = [("a", i, [x, 0.0, 0.0]) for i, x in ((5, 0.0), (1, 9.0), (3, 0.1), (2, 4.0), (9, 4.1))]
    df = spark.createDataFrame(rows, "job_id string, obs_id long, feature array<double>")
    got = {r.obs_id: r.label for r in clustering.density_clusters(df).collect()}
    assert got == {1: -1, 2: 0, 9: 0, 3: 1, 5: 1}


def test_kmeans_separates_far_groups(spark, small_chunks):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0]], dtype=float)
    jobs = {"a": np.concatenate([c + rng.normal(size=(12, 3)) * 0.2 for c in centers]), "b": rng.normal(size=(9, 3))}
    points = kmeans.prepare_points(_frame(spark, jobs))
    first = points.filter("point_id = 0").select("job_id", F.lit(0).alias("label"), "vector")
    k = spark.createDataFrame([("a", 3), ("b", 2)], "job_id string, k long")
    labels = kmeans.kmeans(points, kmeans.farthest_first(points, first, k, 2)).collect()
    of_a = {r.point_id: r.label for r in labels if r.job_id == "a"}
    assert {frozenset(p for p in of_a if of_a[p] == label) for label in set(of_a.values())} == {
        frozenset(range(i * 12, i * 12 + 12)) for i in range(3)
    }
    assert len({r.label for r in labels if r.job_id == "b"}) == 2


def test_farthest_first_stops_at_distinct_points(spark):
    points = kmeans.prepare_points(_frame(spark, {"a": np.array([[0.0, 0, 0], [0, 0, 0], [1, 0, 0]])}))
    first = points.filter("point_id = 0").select("job_id", F.lit(0).alias("label"), "vector")
    k = spark.createDataFrame([("a", 3)], "job_id string, k long")
    assert kmeans.farthest_first(points, first, k, 2).count() == 2


def _observations(spark, rows):
    return spark.createDataFrame(
        rows, "job_id string, obs_id long, source_video string, timestamp double, "
        "bbox struct<x1:int,y1:int,x2:int,y2:int>, embedding array<float>, lip_openness double, cluster_id string",
    )


def test_cluster_faces_end_to_end(spark):
    """Two people side by side in every frame, one frame with a stray third face."""
    rows = []
    for i in range(12):
        person = i % 2
        rows.append(("a", i, "m.mp4", float(i // 2), (200 + 900 * person, 300, 400 + 900 * person, 520),
                     [1.0 if person else 0.0, 0.0 if person else 1.0, 0.2], 0.1 * i, ""))
    rows.append(("b", 0, "m.mp4", 0.0, (0, 0, 100, 100), [1.0, 0.0, 0.0], 0.3, ""))
    sizes = spark.createDataFrame([("a", 1920.0, 1080.0), ("b", 1920.0, 1080.0)], "job_id string, frame_width double, frame_height double")
    got = clustering.cluster_faces(_observations(spark, rows), sizes)
    ids = {(r.job_id, r.obs_id): r.cluster_id for r in got.collect()}
    assert [ids[("a", i)] for i in range(12)] == ["face_0", "face_1"] * 6
    assert ids[("b", 0)] == "face_0"
    summary = {(r.job_id, r.cluster_id): r for r in clustering.cluster_summary(got).collect()}
    assert summary[("a", "face_0")].sample_count == 6
    assert summary[("a", "face_1")].representative_bbox.x1 == 1100


def test_nearest_cluster_ties_and_missing(spark):
    rows = [("a", 0, "m", 0.0, (0, 0, 1, 1), [0.0, 0.0], 0.0, "face_1"), ("a", 1, "m", 0.0, (0, 0, 1, 1), [2.0, 0.0], 0.0, "face_0"),
            ("a", 2, "m", 1.0, (0, 0, 1, 1), [1.0, 0.0], 0.0, ""), ("b", 0, "m", 0.0, (0, 0, 1, 1), [1.0, 0.0], 0.0, "")]
    obs = _observations(spark, rows)
    got = {(r.job_id, r.obs_id): r.cluster_id for r in vectors.nearest_cluster(obs, vectors.centroids(obs)).collect()}
    assert got[("a", 2)] == "face_1"  # as far from both, the cluster seen first wins
    assert got[("b", 0)] == ""
    assert {(r.job_id, r.obs_id): r.cluster_id for r in clustering.assign_noise(obs).collect()}[("a", 2)] == "face_1"


def test_seeding_goes_on_for_the_one_job_that_wants_many(spark):
    rows = [("big", i, [float(i * i), 1.0]) for i in range(24)] + [("small", i, [float(i % 2), 0.0]) for i in range(6)]
    points = kmeans.prepare_points(spark.createDataFrame(rows, "job_id string, point_id long, vector array<double>"))
    first = spark.createDataFrame([("big", 0, [0.0, 1.0]), ("small", 0, [0.0, 0.0])], "job_id string, label int, vector array<double>")
    k = spark.createDataFrame([("big", 9), ("small", 2)], "job_id string, k int")
    got = {}
    for r in kmeans.farthest_first(points, first, k, 8).collect():
        got.setdefault(r.job_id, {})[r.label] = tuple(r.vector)
    seeds = [0.0]
    while len(seeds) < 9:
        seeds.append(max((float(i * i) for i in range(24)), key=lambda x: (min(abs(x - s) for s in seeds), -x)))
    assert [got["big"][i][0] for i in range(9)] == seeds
    assert [got["small"][i][0] for i in range(2)] == [0.0, 1.0]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_closest_of_many_centres(metric):
    """20,000 centres, many of them equal or equally far."""
    rng = np.random.default_rng(11)
    centers = np.concatenate([rng.normal(size=(9_000, 6)) * 3, rng.integers(-3, 4, size=(11_000, 6)).astype(float)])
    rows = np.concatenate([rng.normal(size=(300, 6)) * 3, rng.integers(-3, 4, size=(300, 6)) + 0.5, np.full((3, 6), 500.0)])
    place, distance = vectors.closest(rows, centers, metric)
    for i, row in enumerate(rows):
        every = vectors._distances(row[None, :], centers, metric)[0]
        assert distance[i] == pytest.approx(every.min(), abs=1e-12)
        assert place[i] == np.flatnonzero(every <= every.min() + 1e-12)[0] or metric == "cosine"


def test_nearest_cluster_keeps_columns_over_blocks(spark, small_chunks):
    rng = np.random.default_rng(12)
    rows = [(f"j{i % 2}", i, "m", float(i), (i, 2, 3, 4), None if i == 7 else [float(x) for x in rng.normal(size=3)], 0.5, ["face_0", "face_1", "face_2", ""][i % 4]) for i in range(60)]
    obs = _observations(spark, rows)
    table = vectors.centroids(obs)
    centers = {}
    for r in table.orderBy("cluster_order").collect():
        centers.setdefault(r.job_id, []).append((r.cluster_id, np.array(r.centroid)))
    got = {r.obs_id: r for r in vectors.nearest_cluster(obs, table, out="nearest").collect()}
    assert len(got) == 60 and got[7].nearest == "" and got[7].distance is None
    for job, i, _, ts, box, vector, _, cluster in rows:
        assert (got[i].job_id, got[i].timestamp, tuple(got[i].bbox), got[i].cluster_id) == (job, ts, box, cluster)
        if vector:
            assert got[i].nearest == min(centers[job], key=lambda c: np.linalg.norm(np.float32(vector) - c[1]))[0]
