"""Join helpers: same pairs as a nested loop, also with one key holding nearly everything."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators.joins import around, interval_join, join_facts, nearest_time


def _hot(rng, n):
    return [("hot" if rng.random() < 0.9 else f"job_{rng.randrange(3)}", i, rng.randrange(0, 400) / 4) for i in range(n)]


def test_interval_join_matches_nested_loop(spark):
    rng = random.Random(2)
    points = _hot(rng, 300)
    spans = [(job, i, t, t + rng.choice([-1.0, 0.0, 0.25, 3.0, 60.0])) for job, i, t in _hot(rng, 60)]
    p = spark.createDataFrame(points, "job_id string, p long, t double")
    s = spark.createDataFrame(spans, "job_id string, s long, lo double, hi double")
    for width in (0.5, 4.0, 1000.0):
        got = interval_join(p, s, ["job_id"], "t", "lo", "hi", width, spread=["p"])
        pairs = sorted((r.p, r.s) for r in got.collect())
        assert pairs == sorted((i, k) for job, i, t in points for other, k, lo, hi in spans if job == other and lo <= t <= hi)


def test_interval_join_has_equality_keys(spark):
    p = spark.createDataFrame([("a", 1, 1.0)], "job_id string, p long, t double")
    s = spark.createDataFrame([("a", 1, 0.0, 2.0)], "job_id string, s long, lo double, hi double")
    plan = interval_join(p, s, ["job_id"], "t", "lo", "hi", 4.0, spread=["p"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_time_prefers_earlier(spark):
    probes = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 9.0), ("b", 3, 1.0)], "job_id string, e long, t double")
    targets = spark.createDataFrame([("a", 0.75), ("a", 1.25), ("a", 1.25), ("a", 8.5)], "job_id string, at double")
    got = {r.e: r.m for r in nearest_time(probes, targets, ["job_id"], ["e"], "t", "at", 0.5, "m").collect()}
    assert got == {1: 0.75, 2: 8.5}


def test_join_facts_keeps_left_rows(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("none", 99)], "job_id string, r long")
    facts = spark.createDataFrame([("hot", 7)], "job_id string, v long")
    got = join_facts(rows, facts, ["job_id"], ["r"], "left")
    assert got.count() == 51 and got.filter("v IS NULL").count() == 1
    assert got.agg(F.sum("v")).first()[0] == 350


@pytest.mark.parametrize("seed", [1, 2])
def test_around_equals_a_search_of_sorted_times(spark, seed):
    """One key holds most rows, so its ranges have borders; some keys have only probes or only targets."""
    rng = random.Random(seed)
    targets = [(rng.choice("hhhhhhab"), rng.randint(0, 300) / 4) for _ in range(150)] + [("t", 1.0), (None, 2.0), ("a", None)]
    probes = [(rng.choice("hhhhhhabp"), i, rng.randint(-8, 330) / 4) for i in range(300)] + [(None, 900, 1.0), ("a", 901, None)]
    p = spark.createDataFrame(probes, "job_id string, e int, at double")
    t = spark.createDataFrame(targets, "job_id string, seen double")
    got = {r.e: (r.job_id, r.at, r.before, r.after) for r in around(p, t, ["job_id"], "at", "seen").collect()}
    want = {}
    for key, e, at in probes:
        if key is not None and at is not None:
            times = [x for k, x in targets if k == key and x is not None]
            want[e] = (key, at, max((x for x in times if x <= at), default=None), min((x for x in times if x >= at), default=None))
    assert got == want
    plan = around(p, t, ["job_id"], "at", "seen")._jdf.queryExecution().toString()
    assert "_slot" not in plan and "_salt" not in plan and "explode" not in plan.lower()


def test_nearest_times_write_and_sort_no_probes(spark):
    probes = spark.createDataFrame([("j", i, i * 0.25) for i in range(40)], "job_id string, event_id long, at double")
    frames = spark.createDataFrame([("j", 1.0), ("j", 3.0), ("j", 3.0), ("j", None), ("k", 5.0)], "job_id string, ts double")
    found = nearest_time(probes, frames, ["job_id"], ["event_id"], "at", "ts", 0.5, "frame")
    assert "repartitionByRange" not in (plan := found._jdf.queryExecution().toString()) and "REPARTITION_BY" not in plan and "checkpoint" not in plan
    assert "Window" not in plan
    assert {(r.event_id, r.frame) for r in found.collect()} == {(i, 1.0) for i in range(2, 7)} | {(i, 3.0) for i in range(10, 15)}
