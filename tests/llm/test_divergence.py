import random
import re
from collections import Counter, defaultdict

import pytest
from cases import DOCS

from rollcall.llm import divergence


def table(spark, rows):
    """Rows of (text, lang, source) with columns whose names the operator uses itself."""
    return spark.createDataFrame([(k, t, l, s, 0, 1, 2, 3, 4, 5, "x", "y") for k, (t, l, s) in enumerate(rows)], DOCS)


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower)), l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        groups, holders, whole = defaultdict(Counter), Counter(), Counter()
        for terms, its, source in docs:
            if its == lang:
                groups[source].update(terms)
                holders.update(set(terms))
        kept = [t for t in holders if holders[t] >= 10]
        for counts in groups.values():
            whole.update({t: counts[t] for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) * (p - q) // (p + q)

        shares, of_lang = {s: share(c) for s, c in groups.items()}, share(whole)
        for source, p in shares.items():
            pairs = [(sum(gap(p[t], q[t]) for t in kept), item) for item, q in shares.items() if item != source]
            terms = [(gap(p[t], of_lang[t]), t) for t in kept if groups[source][t] and p[t] > of_lang[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:top], 1)]
    return sorted(out)


def corpus(rng, n):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)] + ["Été", "ÉTÉ", "日本", "a1b2", "it's", "\x00x\x7fy", "ß", "I"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", "Z", None, "\U0001f642", "�"])
        shift = len(source or "") * 20
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words[shift:] if rng.random() < 0.5 else words[:40]) for _ in range(rng.choice([0, 3, 40, 200])))
        rows += [(text, lang, source)] * rng.choice([1, 1, 1, 4])
    rows += [("copied text with terms", rng.choice(["en", "de"]), f"c{k % 7}") for k in range(60)]
    return rows + [("only here", "xx", "one"), (None, "yy", "p"), ("1 2 3", "yy", "q"), ("long " * 50_000, "en", "s2")]


@pytest.mark.parametrize("block,bucket,step", [(256, 1 << 18, 1 << 20), (3, 40, 25)])
def test_audit_equals_brute_force(spark, monkeypatch, block, bucket, step):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "STEP", step)
    monkeypatch.setattr(divergence, "TOGETHER", 4 if block == 3 else 4096)
    rows = corpus(random.Random(block), 160)
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows).repartition(5)).collect())
    wanted = brute(rows)
    assert got == wanted and {r[2] for r in wanted} == {"pair", "term"}


def test_texts_are_collapsed_per_language(spark):
    rows = [("same", "en", "a")] * 3 + [("same", "en", "b"), ("same", "de", "a"), ("other", "en", "a"), (None, "en", "a"), ("", "en", "b")]
    got = sorted((r.lang, bytes(r.text).decode(), sorted((e.source, e.n) for e in r.sources)) for r in divergence.distinct_texts(table(spark, rows)).collect())
    assert got == [("de", "same", [("a", 1)]), ("en", "", [("a", 1), ("b", 1)]), ("en", "other", [("a", 1)]), ("en", "same", [("a", 3), ("b", 1)])]


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = corpus(random.Random(4), 60)
    whole = sorted(tuple(r) for r in divergence.term_counts(table(spark, rows)).collect())
    monkeypatch.setattr(divergence, "HELD", 1)
    assert sorted(tuple(r) for r in divergence.term_counts(table(spark, rows)).collect()) == whole


def test_empty_and_termless_tables(spark):
    assert divergence.audit(table(spark, [("a", "b", "c")]).limit(0)).count() == 0
    got = sorted(tuple(r) for r in divergence.audit(table(spark, [("few", "en", "a"), (None, "en", None)])).collect())
    assert got == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
