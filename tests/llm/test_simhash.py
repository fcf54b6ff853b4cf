import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from cases import documents, odd_texts

from rollcall.llm import simhash


def plain_print(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius=3):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    tables = simhash.masks()
    for bits in combinations(range(64), 3):
        flipped = sum(1 << b for b in bits)
        assert any(not m & flipped for m in tables)


def test_fingerprints(spark):
    texts = odd_texts(random.Random(2))
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: f"{plain_print(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("bucket", [1 << 14, 8, 2])
def test_groups_equal_brute_force(spark, bucket):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(3):  # clouds that chain, far larger than the smaller buckets
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.append(centre)
            for _ in range(rng.randint(0, 5)):
                prints[-1] ^= 1 << rng.randrange(64)
    rows = [(i, simhash._signed(p)) for i, p in enumerate(prints)]
    found = simhash.groups(spark.createDataFrame(rows, "doc_id long, print long"), 3, bucket)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert [got[i] for i in range(len(prints))] == grouped(prints)


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base, base + " more", "quite another text here", "", None, "quite another text here"]
    docs = documents(spark, texts, [5, 3, 9, 4, 7, 8, 4])
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
    nobody = documents(spark, ["a b c d", "a b c d", "e f g h"], [None, None, None])
    assert sorted(r.text for r in simhash.deduplicated(nobody).collect()) == ["a b c d", "e f g h"]
    assert simhash.deduplicated(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest_spans_a_bucket():
    prints = np.array([0, 1, 7, 0xFF, 1 << 40], np.uint64)
    assert simhash._forest(prints, 3).tolist() == [0, 0, 0, 3, 0]
