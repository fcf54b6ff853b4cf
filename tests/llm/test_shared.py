import random

from rollcall.llm import shared


def reached(edges):
    """The smallest node that each node reaches."""
    lowest = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(lowest[a], lowest[b])
            changed |= lowest[a] != low or lowest[b] != low
            lowest[a] = lowest[b] = low
    return lowest


def test_components_equal_brute_force_and_plan_one_half_round_at_a_time(spark, monkeypatch):
    plans, stored = [], shared.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return stored(df)

    monkeypatch.setattr(shared, "stored", watched)
    rng = random.Random(4)
    graphs = [
        ([], 1), ([(7, 7)], 1), ([(5, n) for n in range(6, 40)] + [(-3, 2), (2, -3)], 1),  # nothing, a loop, stars: no round
        ([(n, n + 1) for n in range(-20, 20)], 13),
        ([(rng.randrange(80), rng.randrange(80)) for _ in range(60)], 13),
    ]
    for edges, most in graphs:
        plans.clear()
        found = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
        expected = reached([e for e in edges if e[0] != e[1]])
        assert sorted(map(tuple, found)) == sorted(expected.items())
        assert len(plans) <= most
        assert max(plans) <= 7
