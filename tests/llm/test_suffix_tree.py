import math
import random
import zlib
from collections import Counter

import numpy as np
from cases import documents, odd_texts

from rollcall.llm import suffix_tree as S


def chain(rng, n):
    """Text in which a word depends on the two before it."""
    out = ["a", "b"]
    for _ in range(n):
        out.append("c" if out[-2:] == ["a", "b"] and rng.random() < 0.9 else rng.choice("abd"))
    return " ".join(out)


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(13)
    texts = odd_texts(rng) + [" ".join(rng.choice(["The", "cat", "DOG", "é"]) + str(rng.randrange(40)) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    counts = Counter()
    for i, t in enumerate(texts):
        if not held(i):
            counts.update(S.tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in S.score(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own = S.tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert got[i].held_out == held(i) and got[i].n_tokens == len(own) and got[i].train_tokens == total
        assert got[i].n_known == sum(counts[w] > 0 for w in own)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))


def test_contexts_help_and_distributions_sum_to_one(spark):
    rng = random.Random(14)
    docs = documents(spark, [chain(rng, 300) for _ in range(80)])
    rows = [r for r in S.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.93 * sum(r.base_score for r in rows)  # log10 probabilities: nearer to zero is better
    counts = S.stored(S.word_counts(docs.select("text")))
    tree = S.learn(docs, counts)
    assert [len(level.codes) > 0 for level in tree.levels] == [True, True]
    a, b, c = (tree.ids[w] for w in (b"a", b"b", b"c"))
    for context in ([], [a], [a, b], [b, a], [c, c]):
        mass = 1 / (tree.total + tree.distinct + 1) * 10 ** tree.gain(np.array([-1, *context, -1]))[-1]
        mass += sum(10 ** (tree.logs[i] + tree.gain(np.array([-1, *context, i]))[-1]) for i in tree.ids.values())
        assert abs(mass - 1) < 1e-9, context
    best = 10 ** (tree.logs[c] + tree.gain(np.array([-1, a, b, c]))[-1])
    assert 0.8 < best < 1
    flat = S.learn(docs, counts, divergence=99.0)
    assert not any(level.kept.any() for level in flat.levels)


def test_repeated_null_and_empty(spark):
    known = next(i for i in range(100) if not held(i))
    docs = documents(spark, ["x y", "x y", None, ""], [known, known, None, None])
    rows = S.score(docs).collect()
    assert sorted((r.n_tokens, r.doc_id, r.held_out) for r in rows if r.doc_id is not None) == [(3, known, False)] * 2
    assert [(r.n_tokens, r.held_out) for r in rows if r.doc_id is None] == [(1, False)] * 2
    assert rows[0].train_tokens == 8
    assert S.score(docs.limit(0)).count() == 0
    untrained = next(i for i in range(100) if held(i))
    only = S.score(documents(spark, ["x"], [untrained])).collect()
    assert only[0].base_score == 0 and only[0].score == 0 and only[0].n_known == 0


def test_scores_use_the_whole_tree_whatever_the_shares(spark, monkeypatch):
    rng = random.Random(15)
    docs = documents(spark, [chain(rng, 60) + " " + " ".join(f"w{rng.randrange(30)} v{rng.randrange(4)}" for _ in range(40)) for _ in range(60)])
    training = docs.where("doc_id IN (" + ",".join(str(i) for i in range(60) if not held(i)) + ")")
    tree = S.learn(training, S.stored(S.word_counts(training.select("text"))))  # so few tokens that no share cuts
    assert all(level.kept.any() for level in tree.levels)
    wanted = {}
    for r in docs.collect():
        ids = np.concatenate(([-1], tree.encode(S.tokens(r.text))))
        wanted[r.doc_id] = float(tree.gain(ids)[1:].sum())
    for name, share in (("CONTEXT", 0.05), ("FOLLOWING", 0.01), ("COMMON", 0.02)):
        monkeypatch.setattr(S, name, share)
    rows = S.score(docs).collect()
    assert len(rows) == 60
    for r in rows:
        assert abs(r.score - r.base_score - wanted[r.doc_id]) < 1e-6


def test_depth_grows_with_the_corpus(spark):
    assert [S.depth_for(n) for n in (0, 10**6, 10**9 - 1, 10**9, 10**11)] == [2, 2, 2, 3, 4]
    rng = random.Random(16)
    docs = documents(spark, [" ".join(s for _ in range(20) for s in rng.choice(["a b c d", "x b c e", "y c f"]).split()) for _ in range(60)])
    two, three = ({r.doc_id: r.score for r in S.score(docs, depth=d).collect()} for d in (2, 3))
    assert sum(three.values()) > sum(two.values()) + 100  # what follows "b c" depends on the word before


def test_runs_that_occur_once_stay_in_their_task(spark):
    """Almost every run of these texts occurs once; every one left its task with its context and suffix before."""
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) + " x y z" for _ in range(40)]
    docs = documents(spark, texts).repartition(4).select("text")
    counts = Counter(r for t in texts for w in (S.tokens(t),) for r in zip(w, w[1:], w[2:]))
    bits = S.sketch_bits(40 * 54)
    shared = spark.sparkContext.broadcast(S.sketch(docs.mapInArrow(lambda b: S._text_places(b, [2, 3], bits), S.PLACES), bits))
    sent = docs.mapInArrow(lambda b: S._run_rows(b, 3, shared, 8), S.COUNTS)
    runs = sum(len(S._unpacked(bytes(r.runs))) for r in sent.collect())
    assert 2 * 4 <= runs < 0.4 * len(counts)  # the repeated ones in each task, and some by chance
    found = sent.groupBy("bucket").applyInArrow(S._counting(3), "run long, context long, suffix long, n long").collect()
    assert sorted(r.n for r in found) == sorted(n for n in counts.values() if n > 1)
    words = S.hash_words([b"x", b"y", b"z"])
    xyz = {int(S.hash_shingles(words, 3).view(np.int64)[0]): tuple(S.hash_shingles(words, 2).view(np.int64).tolist())}
    assert xyz.items() <= {r.run: (r.context, r.suffix) for r in found}.items()


def test_packed_numbers_come_back():
    rng = np.random.default_rng(18)
    for n in (1, 2, 1000):
        runs = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert S._unpacked(S._packed(runs)).tolist() == runs.tolist()
        assert S._unmix64(S.mix64(runs)).tolist() == runs.tolist()
        for top in (200, 60_000, 1 << 40):
            numbers = rng.integers(0, top, n)
            assert S._unsmall(S._small(numbers)).tolist() == numbers.tolist()
