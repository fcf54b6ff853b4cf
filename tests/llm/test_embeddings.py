import numpy as np
import pytest

from rollcall.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n long, dim string, first string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, 2, "a", "b", "c") for i, v, l in rows], SCHEMA)


def brute(rows, least=0.93):
    def fits(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    vectors = [np.array(v, np.float32).astype(float) if fits(v, l) else None for _, v, l in rows]
    root, links = list(range(n)), [0] * n

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            u, v = vectors[i], vectors[j]
            if u is None or v is None or rows[i][2] != rows[j][2] or u.size != v.size:
                continue
            if float(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i in range(n):
        smallest[find(i)] = min(rows[i][0], smallest.get(find(i), rows[i][0]))
    return {rows[i][0]: (links[i], smallest[find(i)], rows[i][0] == smallest[find(i)]) for i in range(n)}


def planted(rng):
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 40)):
            rows.append((centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.25, 0.35]), int(c % 3)))
    rows += [(rng.normal(size=24), int(rng.integers(0, 3))) for _ in range(80)]
    rows += [(rng.normal(size=5), 0), (np.ones(5), 1), (np.ones(5) * 1e30, 1), (np.ones(5) * 1e-30, 1), (np.ones(24), None), (None, 1), ([], 1), ([0.0] * 24, 1)]
    rows += [([float("nan")] + [1.0] * 23, 1), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([-0.0, 1.0], 2), ([0.0, 1.0], 2)]
    ids = rng.permutation(5000)[: len(rows)].tolist()
    return [(i, None if v is None else list(v), l) for i, (v, l) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("numbers", [1 << 18, 24 * 7])
def test_links_equal_brute_force(spark, numbers):
    rows = planted(np.random.default_rng(19))
    got = embeddings.near_duplicates(table(spark, rows).repartition(4), tile_numbers=numbers)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    wanted = brute(rows)
    assert sum(v[0] for v in wanted.values()) > 500
    assert found == wanted


def test_early_stop_drops_no_pair():
    rng = np.random.default_rng(20)
    base = rng.normal(size=(6, 200))
    vectors = (base[rng.integers(0, 6, 300)] + rng.normal(size=(300, 200)) * 0.25) @ np.diag(np.linspace(3, 0.1, 200))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    tile = embeddings.Tile(np.arange(300), np.ones(300, np.int64), vectors, axes)
    got = {(i, j) for a, b in embeddings.pairs_of(tile, tile, 0.93, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if unit[i] @ unit[j] >= 0.93}


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0)]
    got = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("1", 2, 1, True), ("1", 2, 1, True), ("None", 2, 1, False)]
    assert embeddings.near_duplicates(table(spark, rows).limit(0)).count() == 0
