import hashlib
import random
from itertools import combinations

import numpy as np
from cases import documents, odd_texts

from rollcall.llm import minhash


def sets(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_report_follows_the_order_of_ids(spark):
    rng = random.Random(6)
    texts = odd_texts(rng) + [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 400))) for _ in range(60)]
    ids = rng.sample(range(-500, 500), len(texts))
    got = {r.doc_id: r for r in minhash.edit_report(documents(spark, texts, ids).repartition(4)).collect()}
    order = sorted(range(len(ids)), key=ids.__getitem__)
    assert len(got) == len(ids)
    for at, k in enumerate(order):
        own, following = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        row = got[ids[k]]
        assert row.n_chars == len(own)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == minhash.written(minhash.signature(minhash.shingles(own)))
        assert row.edited_fingerprint == minhash.written(minhash.signature(minhash.shingles(changed)))
        assert abs(row.near_edited - jaccard(sets(own), sets(changed))) < 0.25
        assert abs(row.near_next - jaccard(sets(own), sets(following))) < 0.25


def test_ties_nulls_single_rows_and_empty_tables(spark):
    docs = documents(spark, ["b b", "a a", "a a", None], [1, 1, None, None])
    rows = minhash.edit_report(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == [("1", 3), ("1", 3), ("None", 0), ("None", 3)]
    sole = minhash.edit_report(documents(spark, ["x y z"])).collect()
    assert len(sole) == 1 and sole[0].near_next == 1.0
    assert minhash.edit_report(docs.limit(0)).count() == 0 and minhash.near_duplicates(docs.limit(0)).count() == 0


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(9)
    gaps = []
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        a, b = both, np.concatenate((both[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)))
        gaps.append(minhash.likeness(minhash.signature(a), minhash.signature(b)) - n / (4000 - n))
    assert max(map(abs, gaps)) < 0.15


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 4)
    rng = random.Random(10)
    texts = []
    for d in range(25):
        words = [f"d{d}w{k}" for k in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 5)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = f"n{rng.random()}"
            texts.append(" ".join(changed))
    texts += odd_texts(rng)
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    shingled = [sets(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if jaccard(shingled[i], shingled[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def family(rng):
    """Texts with many edited copies each: a copy is alike to the text and to hardly any other copy."""
    texts = []
    for d in range(2):
        base = [f"d{d}w{k}" for k in range(120)]
        texts.append(" ".join(base))
        for _ in range(200):
            changed = list(base)
            for k in rng.sample(range(5, 115, 5), 2):
                changed[k] = f"n{rng.random()}"
            texts.append(" ".join(changed))
    return texts


def test_outliers_of_large_families_stay_linked(spark, monkeypatch):
    rng = random.Random(11)
    texts = family(rng)
    shingled = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(shingled[i], shingled[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    for hot in (256, 1):
        monkeypatch.setattr(minhash, "HOT", hot)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_outliers_of_a_family_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)]
    for _ in range(300):
        changed = list(base)
        for k in rng.sample(range(5, 195, 5), rng.randint(1, 12)):
            changed[k] = f"n{rng.random()}"
        texts.append(" ".join(changed))
    monkeypatch.setattr(minhash, "HOT", 1)
    compared, plain = [], minhash._alike
    monkeypatch.setattr(minhash, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    alike = {i for i in range(1, 301) if jaccard(sets(texts[i]), sets(texts[0])) >= 0.8}
    assert len(alike) < 200 and {i for i in got if got[i] == 0} >= alike
    assert sum(compared) < 15 * len(texts)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(15)
    for size in (0, 40, 3000):
        every = rng.integers(0, 1 << 63, size + 60, dtype=np.uint64)
        a, b = every[:size], every[rng.integers(0, 50) :]
        bits = sum(int(x).bit_count() for x in (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64))
        assert bits <= np.setxor1d(a, b).size


def test_a_shingle_that_only_the_head_lacks_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(16)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:-1] + ["end"])]
    for _ in range(250):
        changed = list(base)
        for k in [0, *rng.sample(range(6, 190, 6), 4)]:
            changed[k] = f"n{rng.random()}"
        texts.append(" ".join(changed))
    texts += [t + " more" for t in texts[1:8]]
    shingled = [sets(t) for t in texts]
    near = {(j, i) for i, j in combinations(range(len(texts)), 2) if jaccard(shingled[i], shingled[j]) >= 0.8}
    monkeypatch.setattr(minhash, "HOT", 1)
    compared, plain = [], minhash._alike
    monkeypatch.setattr(minhash, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert near and all(got[a] == got[b] for a, b in near) and len(set(got.values())) > 200
    assert sum(compared) < 15 * len(texts)
