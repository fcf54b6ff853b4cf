import random

import public_tokenizers
from cases import documents, odd_texts
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rollcall.llm import token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts(rng):
    mixed = ["".join(rng.choice("ab \n\t'sé<|>1. 　日▁=-/🙂\0") for _ in range(n)) for n in (1, 7, 300, 40_000)]
    return odd_texts(rng) + mixed + ["<s> </s><unk> <0x0A>", " ", "  ", "a ", " a", "▁▁", "=" * 50_000, " " * 40_000, "x" + " " * 40_000 + "y", "日本" * 30_000]


def test_counts_equal_whole_texts(spark):
    cases = texts(random.Random(11))
    whole = SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, cases).repartition(3), PIECES).collect()}
    assert len(got) == len(cases)
    for k, text in enumerate(cases):
        row = got[k]
        assert row.n_tokens == len(whole.encode(text or ""))
        assert row.n_bytes == len((text or "").encode())
        assert row.over_limit == (row.n_tokens > 4096)


def test_every_cut_is_safe(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 3)
    monkeypatch.setattr(token_counts, "BATCH", 40)
    with open(PIECES, "rb") as file:
        counter = token_counts.Pieces(file.read())
    rng = random.Random(12)
    cases = ["".join(rng.choice("abcde theing  \n.日é▁") for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    assert token_counts.count(counter, cases).tolist() == [len(x) for x in counter.processor.encode(cases)]
    assert sum(len(list(counter.parts(t))) > 1 for t in cases) > 2_000
    for text in cases:
        parts = list(counter.parts(text))
        assert "".join(p if not extra else p.removeprefix("\n") for p, extra in parts) == text


def test_tokenizers_files(spark):
    cases = ["A b  c", "<|startoftext|> x", None, ""]
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, cases), WORDS).collect()}
    assert got == {k: len(whole.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(cases)}


def test_limit_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, ["a b c", "a b c", None], [None, None, 3])
    rows = token_counts.count_tokens(docs, PIECES, limit=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [("3", 0, 0, False), ("None", 5, 3, True), ("None", 5, 3, True)]
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0
