import random
from itertools import combinations

from cases import documents, odd_texts
from test_minhash import jaccard, sets
from test_simhash import plain_print

from rollcall.llm import near_copies


def grouped(texts):
    """The first text that links of either kind reach, for every text."""
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    prints, shingled = [plain_print(t, 5) for t in texts], [sets(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 or jaccard(shingled[i], shingled[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_groups_of_both_kinds_of_links_keep_their_first(spark):
    rng = random.Random(12)
    texts = odd_texts(rng)
    for d in range(12):
        base = [f"d{d}w{k}" for k in range(150)]
        for _ in range(rng.randint(1, 6)):
            changed = list(base)
            for k in rng.sample(range(150), rng.randint(0, 4)):
                changed[k] = f"n{rng.random()}"
            texts += [" ".join(changed)] * rng.randint(1, 2)
    rng.shuffle(texts)
    roots = grouped(texts)
    kept = near_copies.deduplicated(documents(spark, texts).repartition(3))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, r in enumerate(roots) if i == r]
    alone = [plain_print(t, 5) for t in texts]
    assert any(roots[i] == roots[j] and (alone[i] ^ alone[j]).bit_count() > 3 for i, j in combinations(range(len(texts)), 2))


def test_repeated_rows_ties_nulls_and_nothing(spark):
    base = [f"w{i}" for i in range(400)]
    other = " ".join(base[:200] + ["new"] + base[201:])
    texts = [" ".join(base), " ".join(base), other, "quite another text here", "", None, "quite another text here"]
    docs = documents(spark, texts, [5, 3, 9, 4, 7, 8, 4])
    assert sorted(r.doc_id for r in near_copies.deduplicated(docs).collect()) == [3, 4, 7]
    tied = near_copies.deduplicated(documents(spark, [" ".join(base), other, "x"], [1, 1, None])).collect()
    assert sorted(str(r.doc_id) for r in tied) == ["1", "None"]
    nobody = documents(spark, ["a b c d", "a b c d", "e f g h"], [None, None, None])
    assert sorted(r.text for r in near_copies.deduplicated(nobody).collect()) == ["a b c d", "e f g h"]
    assert near_copies.deduplicated(docs.limit(0)).count() == 0
