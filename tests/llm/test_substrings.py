import hashlib
import random

import pytest
from cases import documents, odd_texts

from rollcall.llm import substrings


def brute(ids, texts, window=13):
    words = [(t or "").encode().split() for t in texts]
    least = {}
    for i, own in zip(ids, words, strict=True):
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, own in zip(ids, words, strict=True):
        lost = set()
        for k in range(len(own) - window + 1):
            if i is not None and least[tuple(own[k : k + window])] < i:
                lost |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(own) if k not in lost)
        out.append((i, len(own), len(lost), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    passages = [" ".join(f"p{j}x{k}" for k in range(rng.randint(13, 60))) for j in range(4)]
    texts = []
    for d in range(60):
        parts = [" ".join(f"d{d}w{rng.randrange(500)}" for _ in range(rng.randint(0, 40))) for _ in range(3)]
        texts.append("\n".join([parts[0], rng.choice(passages), parts[1], rng.choice(["", *passages]), parts[2]]))
    return texts + odd_texts(rng) + ["go " * 60, "go " * 30]


@pytest.mark.parametrize("large", [1 << 25, 2_000, 0])
def test_removal_equals_brute_force(spark, large):
    texts = corpus(random.Random(7))
    ids = random.Random(8).sample(range(1000), len(texts))
    docs = documents(spark, texts, ids).repartition(5)
    got = substrings.remove_repeats(docs, bucket_bytes=5_000, large_bytes=large, with_text=False)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ids, texts)


def test_ties_nulls_and_empty_tables(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = documents(spark, [same, same, same, same, "other"], [2, 2, 7, None, None])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(2, 20, 0, same), (2, 20, 0, same), (7, 20, 20, ""), (None, 20, 0, same), (None, 1, 0, "other")], key=str)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    import zstandard

    from rollcall.llm.words import hash_shingles as real

    monkeypatch.setattr(substrings, "hash_shingles", lambda h, w: real(h, w) & 1)
    packs = substrings.Packs()
    texts = [" ".join(f"{c}{i}" for i in range(16)).encode() for c in "abcab"]
    for doc, text in enumerate(texts):
        packs.add(text, 1, doc, doc, 0, 4, 13) if doc < 3 else packs.add(text + b" z", 1, doc, doc, 0, 5, 13)
    blobs = [b for batch in packs.batches(1) for b in batch.column("blob").to_pylist() if b]
    assert zstandard.frame_content_size(blobs[0]) > 0
    assert sorted(map(tuple, substrings.Bucket(blobs, 13).ranges().tolist())) == [(3, 0, 16), (4, 0, 16)]
