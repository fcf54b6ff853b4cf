import hashlib
import random
from collections import defaultdict

import pytest
from cases import documents, odd_texts

from rollcall.llm import mixing


def targets(sizes):
    """The rule as said: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def corpus(rng, n=300):
    sources = [rng.choice(["a", "a", "a", "a", "b", "é", "zz", "Z", None]) for _ in range(n)]
    return [None if rng.random() < 0.05 else " ".join(["w"] * rng.randint(0, 60)) for _ in range(n)], sources


@pytest.mark.parametrize("slice_rows", [2000, 5])
def test_mix_reaches_its_targets(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    texts, sources = corpus(random.Random(11))
    rows = mixing.mix(documents(spark, texts, sources=sources).repartition(3)).collect()
    sizes, ordered = defaultdict(int), defaultdict(list)
    for i, (t, s) in enumerate(zip(texts, sources, strict=True)):
        sizes[s] += len((t or "").split())
        ordered[s].append((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i))
    wanted = targets(sizes)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for s, members in ordered.items():
        whole, rest = divmod(int(wanted[s]), sizes[s])
        for _, i in sorted(members):
            size = len((texts[i] or "").split())
            assert got[i].size == size and got[i].source_size == sizes[s] and abs(got[i].target - wanted[s]) < 1e-6
            part = min(size, max(0, rest))
            assert got[i].taken == whole * size + part
            rest -= size
    again = {r.doc_id: r.taken for r in mixing.mix(documents(spark, texts, sources=sources).repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_documents_of_the_mix(spark):
    texts, sources = corpus(random.Random(12), 120)
    docs = documents(spark, texts, sources=sources)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    words = defaultdict(int)
    for r in made.collect():
        assert (texts[r.doc_id] or "").startswith(r.text) and r.n_chars == len(r.text) and r.size == 3
        words[r.source] += len(r.text.split())
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    assert {s: n for s, n in words.items() if n} == {s: int(t) for s, t in targets(sizes).items() if int(t)}


def test_odd_rows(spark):
    texts = odd_texts(random.Random(1))
    rows = mixing.mix(documents(spark, texts, [None, None, *range(len(texts) - 2)])).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode().split()) for t in texts)
    assert mixing.mix(documents(spark, [None, ""], [1, 1])).collect()[0].taken == 0
    assert mixing.mix(documents(spark, ["a"]).limit(0)).count() == 0 and mixing.mixed_documents(documents(spark, ["a"]).limit(0)).count() == 0
