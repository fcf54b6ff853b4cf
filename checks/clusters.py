"""Face cluster queries: C1-C13."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sampling import FEATURE, frame_size
from checks.speakers import R11
from checks.views import with_views
from rollcall.llm.shared import stored
from rollcall.operators import clustering, kmeans, vectors, ward
from rollcall.operators.sampling import add_features
from rollcall.session import cut_lineage

OBS = with_views("obs_v")
# R11 opens with the best frame and ends with centroids of each cluster.
CENT = R11


@query("c1_faces_per_timestamp", OBS + " SELECT job_id, ts_s, count(*) AS faces FROM obs_v GROUP BY job_id, ts_s")
def _(t):
    return clustering.faces_per_timestamp(t.obs).withColumnRenamed("timestamp", "ts_s")


@query("c1_faces_per_frame", OBS + " SELECT job_id, source_video, ts_s, count(*) AS faces FROM obs_v GROUP BY ALL")
def _(t):
    return clustering.faces_per_timestamp(t.obs, "distinct_frame").withColumnRenamed("timestamp", "ts_s")


@query("c2_person_count", OBS + """, c AS (SELECT job_id, ts_s, count(*) AS n FROM obs_v GROUP BY job_id, ts_s)
SELECT job_id, n AS people, ts_s AS full_ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, ts_s) AS rn FROM c) q
WHERE rn = 1""")
def _(t):
    return clustering.person_count(clustering.faces_per_timestamp(t.obs))


@query("c6_centroids", CENT + """ SELECT job_id, cluster_id, ord AS cluster_order, generate_subscripts(centroid, 1) - 1 AS pos,
  round(unnest(centroid), 6) AS value FROM cent""")
def _(t):
    table = vectors.centroids(t.obs)
    return table.select("job_id", "cluster_id", "cluster_order", F.posexplode("centroid").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


def _nearest(measure: str) -> str:
    return CENT + f""",
n AS (SELECT o.job_id, o.obs_id, c.cluster_id AS nearest, {measure} AS d, row_number() OVER (
  PARTITION BY o.job_id, o.obs_id ORDER BY {measure}, c.ord) AS rn FROM obs_v o JOIN cent c ON c.job_id = o.job_id)"""


EUCLID = "list_distance(CAST(o.embedding AS DOUBLE[]), c.centroid)"
COSINE = """1.0 - list_inner_product(CAST(o.embedding AS DOUBLE[]), c.centroid) / (sqrt(list_inner_product(CAST(o.embedding AS DOUBLE[]),
  CAST(o.embedding AS DOUBLE[]))) * sqrt(list_inner_product(c.centroid, c.centroid)) + 1e-8)"""


def _rounded(df):
    return df.select("job_id", "obs_id", "nearest", F.round("distance", 6).alias("distance"))


@query("c8_nearest_euclidean", _nearest(EUCLID) + " SELECT job_id, obs_id, nearest, round(d, 6) AS distance FROM n WHERE rn = 1")
def _(t):
    return _rounded(vectors.nearest_cluster(t.obs, vectors.centroids(t.obs), out="nearest"))


@query("c9_nearest_cosine", _nearest(COSINE) + " SELECT job_id, obs_id, nearest, round(d, 6) AS distance FROM n WHERE rn = 1")
def _(t):
    return _rounded(vectors.nearest_cluster(t.obs, vectors.centroids(t.obs), "cosine", out="nearest"))


@query("c10_matches_expected", _nearest(EUCLID) + """ SELECT n.job_id, n.obs_id,
  o.cluster_id <> '' AND n.nearest = o.cluster_id AS matches FROM n JOIN obs_v o ON o.job_id = n.job_id AND o.obs_id = n.obs_id WHERE rn = 1""")
def _(t):
    found = vectors.nearest_cluster(t.obs, vectors.centroids(t.obs), out="nearest")
    return vectors.matches_expected(found, "cluster_id", "nearest").select("job_id", "obs_id", "matches")


@query("c7_assign_noise", _nearest(EUCLID) + """ SELECT o.job_id, o.obs_id, CASE WHEN o.cluster_id = '' THEN n.nearest ELSE o.cluster_id END AS cluster_id,
  o.cluster_id = '' AS was_noise FROM obs_v o JOIN n ON n.job_id = o.job_id AND n.obs_id = o.obs_id WHERE n.rn = 1""")
def _(t):
    return clustering.assign_noise(t.obs).select("job_id", "obs_id", "cluster_id", "was_noise")


@query("c7_noise_counts", OBS + " SELECT job_id, count(*) FILTER (cluster_id = '') AS noise_count FROM obs_v GROUP BY job_id")
def _(t):
    return clustering.noise_counts(t.obs.withColumn("was_noise", F.col("cluster_id") == ""))


@query("c11_cluster_summary", OBS + """ SELECT job_id, cluster_id, sample_count, x1, y1, x2, y2,
  'face_thumbnails/' || cluster_id || '.jpg' AS thumbnail_path FROM (SELECT *, count(*) OVER (PARTITION BY job_id, cluster_id) AS sample_count,
  row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY lip_openness DESC, obs_id) AS rn FROM obs_v WHERE cluster_id <> '') q WHERE rn = 1""")
def _(t):
    return clustering.cluster_summary(t.obs).select("job_id", "cluster_id", "sample_count", "representative_bbox.*", "thumbnail_path")


@query("c13_cluster_ids", "SELECT event_id, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'face_' || (user_id % 9) END AS cluster_id FROM events")
def _(t):
    label = F.when(F.col("user_id") % 9 == 0, -1).otherwise(F.col("user_id") % 9)
    return t.table("events").select("event_id", clustering.cluster_id(label).alias("cluster_id"))


def features(t):
    return cut_lineage(add_features(t.obs, frame_size(t)).select("job_id", "obs_id", "timestamp", "feature"))


PAIRS = OBS + f""",
f AS (SELECT job_id, obs_id, {FEATURE} AS f FROM obs_v),
edges AS (SELECT a.job_id, a.obs_id AS a, b.obs_id AS b FROM f a JOIN f b ON b.job_id = a.job_id AND b.obs_id <> a.obs_id
  WHERE list_distance(a.f, b.f) <= 0.55),
l0 AS (SELECT job_id, obs_id, obs_id AS comp FROM obs_v)"""
for _step in range(1, 13):
    PAIRS += f""",
l{_step} AS MATERIALIZED (SELECT l.job_id, l.obs_id, least(l.comp, coalesce(min(n.comp), l.comp)) AS comp FROM l{_step - 1} l
  LEFT JOIN edges e ON e.a = l.obs_id AND e.job_id = l.job_id LEFT JOIN l{_step - 1} n ON n.obs_id = e.b GROUP BY l.job_id, l.obs_id, l.comp)"""
PAIRS = PAIRS.replace("edges AS (", "edges AS MATERIALIZED (") + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY job_id, comp) AS n FROM l12),
c4 AS (SELECT job_id, obs_id, CASE WHEN n = 1 THEN -1 ELSE dense_rank() OVER (PARTITION BY job_id, n > 1 ORDER BY comp) - 1 END AS label FROM sized)"""


@query("c4_density_clusters", PAIRS + " SELECT job_id, obs_id, label FROM c4")
def _(t):
    seen = t.obs.select("job_id", "obs_id", "timestamp", "embedding", "bbox")
    return clustering.density_clusters(add_features(seen, stored(frame_size(t))))  # not written: features are longer than what they are made of


@query("c5_choose_clustering", OBS + """,
people AS (SELECT job_id, max(n) AS people FROM (SELECT job_id, ts_s, count(*) AS n FROM obs_v GROUP BY job_id, ts_s) q GROUP BY job_id),
found AS (SELECT job_id, count(DISTINCT x1 % 7 + 7 * (obs_id % 2)) AS found FROM obs_v WHERE cluster_id <> '' GROUP BY job_id)
SELECT o.job_id, o.obs_id, CASE WHEN p.people > 1 AND f.found > p.people THEN
  CASE WHEN o.cluster_id = '' THEN -1 ELSE o.x1 % 7 + 7 * (o.obs_id % 2) END ELSE o.obs_id % 5 END AS label
FROM obs_v o JOIN people p ON p.job_id = o.job_id JOIN found f ON f.job_id = o.job_id""")
def _(t):
    obs = t.obs
    people = clustering.person_count(clustering.faces_per_timestamp(obs))
    by_count = obs.select("job_id", "obs_id", (F.col("obs_id") % 5).alias("label"))
    marked = F.when(F.col("cluster_id") == "", -1).otherwise(F.col("bbox.x1") % 7 + 7 * (F.col("obs_id") % 2))
    return clustering.choose_clustering(by_count, obs.select("job_id", "obs_id", marked.alias("label")), people)


# Assignment and update of the face clustering, from the faces of the fullest frame as centres.
FACE_STEP = OBS + f""",
f AS (SELECT job_id, obs_id, ts_s, {FEATURE} AS f FROM obs_v),
c AS (SELECT job_id, ts_s, count(*) AS n FROM obs_v GROUP BY job_id, ts_s),
full_frame AS (SELECT job_id, ts_s FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, ts_s) AS rn FROM c) q WHERE rn = 1 AND n > 1),
seeds AS (SELECT job_id, vec, row_number() OVER (PARTITION BY job_id ORDER BY first_obs) - 1 AS label FROM (
  SELECT f.job_id, f.f AS vec, min(f.obs_id) AS first_obs FROM f JOIN full_frame u ON u.job_id = f.job_id AND u.ts_s = f.ts_s GROUP BY f.job_id, f.f) q),
a AS (SELECT job_id, obs_id, label, f FROM (SELECT f.job_id, f.obs_id, s.label, f.f, row_number() OVER (
  PARTITION BY f.job_id, f.obs_id ORDER BY round(list_distance(f.f, s.vec), 9), s.label) AS rn FROM f JOIN seeds s ON s.job_id = f.job_id) q WHERE rn = 1)"""


def _face_points(t):
    table = features(t)
    people = clustering.person_count(clustering.faces_per_timestamp(t.obs))
    points = kmeans.prepare_points(table.select("job_id", F.col("obs_id").alias("point_id"), F.col("feature").alias("vector")))
    return points, clustering.frame_seeds(table, people)


@query("c3_assign_step", FACE_STEP + " SELECT job_id, obs_id, label FROM a")
def _(t):
    points, seeds = _face_points(t)
    return kmeans.assign(points, seeds).withColumnRenamed("point_id", "obs_id")


@query("c3_update_step", FACE_STEP + """ SELECT job_id, label, pos, round(avg(v), 6) AS value FROM (SELECT job_id, label, unnest(f) AS v,
  generate_subscripts(f, 1) - 1 AS pos FROM a) q GROUP BY job_id, label, pos""")
def _(t):
    points, seeds = _face_points(t)
    moved = kmeans.update(points, seeds)
    return moved.select("job_id", "label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


# The pairs that merge in the first round of the Ward tree. Equal features are one cluster from the start.
MERGE_ROUND = OBS + f""",
f AS (SELECT job_id, obs_id, {FEATURE} AS f FROM obs_v),
g AS (SELECT job_id, f, min(obs_id) AS node, count(*) AS n FROM f GROUP BY job_id, f),
p AS (SELECT a.job_id, a.node AS a, b.node AS b, round(a.n * b.n / (a.n + b.n) * pow(list_distance(a.f, b.f), 2), 9) AS cost,
  (least(a.node, b.node) % 2147483647 * 48271 + greatest(a.node, b.node) % 2147483647 * 69621) % 2147483647 AS tie
  FROM g a JOIN g b ON b.job_id = a.job_id AND b.node <> a.node),
best AS (SELECT job_id, a, b, cost FROM (SELECT *, row_number() OVER (PARTITION BY job_id, a ORDER BY cost, tie, b) AS rn FROM p) q WHERE rn = 1)
SELECT x.job_id, x.b AS absorbed, x.a AS into_node, round(x.cost, 6) AS height FROM best x JOIN best y ON y.job_id = x.job_id AND y.a = x.b AND y.b = x.a
WHERE x.a < x.b"""


@query("c3_ward_merge_round", MERGE_ROUND)
def _(t):
    seen = t.obs.select("job_id", "obs_id", "embedding", "bbox")
    sizes = seen.groupBy("job_id").agg(F.sum(F.size("embedding") + 3).alias("numbers"))  # and the position
    # An embedding has half the bytes of its feature. The frame sizes are written, so that Spark knows that they are few and moves no embedding to them.
    dealt = add_features(seen.repartition("job_id"), stored(frame_size(t)))
    merges = ward.first_round(dealt.select("job_id", F.col("obs_id").alias("point_id"), F.col("feature").alias("vector")), sizes)
    return merges.select("job_id", "absorbed", F.col("into").alias("into_node"), F.round("cost", 6).alias("height"))


@query("c3_k_cluster_faces")
def _(t):
    return clustering.k_cluster_faces(features(t), clustering.person_count(clustering.faces_per_timestamp(t.obs)))


@query("c12_recluster_faces")
def _(t):
    return clustering.cluster_faces(t.obs, frame_size(t)).select("job_id", "obs_id", "cluster_id", "was_noise")
