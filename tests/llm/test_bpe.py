import hashlib
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import public_tokenizers
from cases import documents, odd_texts
from tokenizers import Tokenizer

from rollcall.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    whole = Tokenizer.from_file(FILE)
    return [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_equal_the_librarys(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + ["x <|endoftext|> y" * 400, "  <|endoftext|>\n\n" * 300, "a's  b'll\r\n" * 900]
    texts += ["".join(rng.choice("ab \n\t'sé<|>1. 　日") for _ in range(20_000)) for _ in range(3)]
    got = {r.doc_id: r for r in bpe.encode(documents(spark, texts), FILE).collect()}
    for i, ids in enumerate(expected(texts)):
        assert got[i].ids == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_shared_chunks_are_encoded_once():
    with open(FILE, encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    rng = random.Random(5)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(20_000))
    for head in ("first start ", "another beginning, longer than the first "):
        text = head + body
        assert codec.encode(text).tolist() == expected([text])[0]
    assert codec.n_reused > 0.8 * codec.n_encoded


def test_chunk_cuts_cover_the_text():
    raw = ("é日 ab" * 9_000).encode()
    pieces = bpe.cut_chunks(raw)
    assert b"".join(pieces) == raw and len(pieces) > 2
    assert all(p.decode() for p in pieces) and max(map(len, pieces)) <= bpe.LARGEST + 3


def test_empty_table_and_null_ids(spark):
    docs = documents(spark, ["a", "a"], [None, None])
    assert bpe.encode(docs.limit(0), FILE).count() == 0
    assert [r.n_tokens for r in bpe.encode(docs, FILE, with_ids=False).collect()] == [1, 1]


def test_kept_chunks_take_little_more_than_their_text_and_ids():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    assert "whole" not in vars(codec)  # a second encoder in every worker, only for texts that need it
    pieces = [b" ".join(b"word%d" % (k * 300 + i) for i in range(250)) for k in range(200)]
    tracemalloc.start()
    chunks = [codec.chunk(piece) for piece in pieces]
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < sum(c.ids.nbytes + 1200 for c in chunks)
    assert all(len(c.edges) == len(c.packed_edges) > 2 for c in chunks)


LEFT = """
import random, re, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from rollcall.llm import bpe

def taken():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", file.read()).group(1)) // 1024

class Spec:
    with open(sys.argv[2], encoding="utf-8") as file:
        value = file.read()

def batches():
    rng = random.Random(8)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(6000)) for _ in range(5)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})

before = taken()
for rows in bpe._encode_rows(batches(), Spec, True):
    pass
del rows
print(taken() - before)
"""


def test_a_worker_gives_the_encoders_memory_back():
    root = str(Path(__file__).resolve().parents[2])
    left = subprocess.run([sys.executable, "-c", LEFT, root, FILE], capture_output=True, text=True, check=True).stdout
    assert int(left) < 60
