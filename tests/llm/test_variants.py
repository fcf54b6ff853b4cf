import random
import re
import zlib
from collections import Counter

from cases import documents, odd_texts

from rollcall.llm import variants


def near(a, b):
    """One edit apart, by trying the place of the first difference."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(texts, ids):
    counts = Counter()
    for doc, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, links = {}, {}
    for word, n in kept.items():
        others = [o for o in kept if near(word, o)]
        links[word] = len(others)
        best = min(others, key=lambda o: (-kept[o], o), default=None)
        forms[word] = best if best and kept[best] >= 5 * n else None
    out = []
    for word, n in kept.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, forms[word], root, n, links[word], kept[forms[word]] if forms[word] else None))
    return sorted(out)


def edited(rng, word):
    at, c = rng.randrange(len(word)), rng.choice("abcxyzéÿÉ×")
    return rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


def corpus(rng):
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababababab", "bababababa", "Straße", "naïveté", "ÉCOLES"]
    bag = []
    for word in base:
        bag += [word] * rng.choice([5, 30, 200])
        for _ in range(4):
            one = edited(rng, word)
            two = edited(rng, one)
            bag += [one] * rng.choice([4, 5, 6, 35]) + [two] * rng.choice([1, 5, 7])
    rng.shuffle(bag)
    texts = [" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in bag[k : k + 50]) + rng.choice([".", "!1", "日"]) for k in range(0, len(bag), 50)]
    return texts + odd_texts(rng) + ["repeated words Repeated_wordS"] * 9


def test_variants_equal_brute_force(spark):
    rng = random.Random(21)
    texts = corpus(rng)
    ids = [None if rng.random() < 0.02 else k for k in rng.sample(range(-900, 90_000), len(texts))]
    got = sorted(tuple(r) for r in variants.group_variants(documents(spark, texts, ids).repartition(4)).collect())
    wanted = brute(texts, ids)
    assert got == wanted
    assert any(r[1] and r[2] != r[1] for r in wanted) and sum(r[4] > 3 for r in wanted) > 20


def test_every_near_pair_is_found(spark):
    rng = random.Random(22)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 10))) for _ in range(1500)} | {"a" * k for k in range(6, 30)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in variants.near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(23)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 12)))
        counts = {word[k : k + 2]: rng.randint(1, 9) for k in range(len(word) - 1)}
        prefix = variants.prefix_of(word, counts)
        pivots = variants.pivots_of(word, prefix, counts)
        cost = {at: counts[word[at : at + 2]] for at in prefix}
        assert len(prefix) == 3 and len(pivots) == 2 and pivots[1] - pivots[0] >= 2
        assert sum(cost[at] for at in pivots) == min(cost[a] + cost[b] for a in prefix for b in prefix if b - a >= 2)


def test_long_chains_of_forms(spark):
    steps = [(f"w{k}", f"w{k + 1}") for k in range(25)] + [("x", "w3"), ("y", "w25")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {a: "w25" for a, _ in steps}


def test_empty_tables_and_texts_without_words(spark):
    docs = documents(spark, [None, "", "short", "1234567 !!"])
    assert variants.group_variants(docs).count() == 0
    assert variants.group_variants(docs.limit(0)).count() == 0
