"""Quality classifier over learned subword embeddings (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.words import PIECE_BYTES, by_bytes, hash_shingles, hash_words

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (1, 3, 4)
#: Words of the runs of which each repeat counts as a feature of its own, and how often.
REPEAT, AGAIN = 3, 2
#: Features that every document has besides its own, all of no effect, so that a few words do not decide alone.
PRIOR = 40
#: Most labelled documents that training sees, and the most characters that one of them may have.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 250_000
EPOCHS = 6
RATE = 0.2
ACCEPT = 0.7


def feature_ids(text: str) -> Iterator[np.ndarray]:
    """Buckets of the hashed words and byte n-grams of a whole text, piece by piece; words are runs without ASCII white space.

    The first two buckets also count the runs of words that the piece repeats and those that it does not.
    """
    words = text.encode().split()
    for first, past in _pieces(words):
        part = words[first:past]
        hashes = hash_words(part)
        yield (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        runs = hash_shingles(hashes, REPEAT)
        again = 2 * runs.size - 2 * np.unique(runs).size + int((hashes[1:] == hashes[:-1]).sum())
        yield np.repeat(np.arange(2), (AGAIN * again, AGAIN * (3 * len(part) - again)))
        raw = np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8).astype(np.uint64)
        for n in GRAMS:
            if raw.size >= n:
                codes = np.full(raw.size - n + 1, n, np.uint64)
                for k in range(n):
                    codes = codes << np.uint64(8) | raw[k : raw.size - n + 1 + k]
                yield (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _pieces(words: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, word in enumerate(words):
        size += len(word) + 1
        if size >= PIECE_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(words):
        yield first, len(words)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often each occurs."""
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for ids in feature_ids(text):
        found, counts = np.unique(ids, return_counts=True)
        merged, at = np.unique(np.concatenate((total[0], found)), return_inverse=True)
        total = merged, np.bincount(at, np.concatenate((total[1], counts)), merged.size)
    return total[0].astype(np.int32), total[1].astype(np.float32)


@dataclass
class Model:
    """Per feature the difference that it makes to the two classes' logits, and the difference of their biases."""

    pull: np.ndarray
    bias: float
    learned: bool = True  # whether there was a labelled document to learn from

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for ids in feature_ids(text):
            total += float(self.pull[ids].sum(dtype=np.float64))
            n += ids.size
        return float(1 / (1 + np.exp(-(total / (n + PRIOR) + self.bias))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent on the softmax of two classes over averaged feature vectors.

    ``rows`` are (features, counts, label). The order of rows is shuffled with ``seed``, the rate falls to zero in a
    straight line. A step moves a document's mean vector by the gradient whatever its length. With no rows every score is 0.5; with one class, scores lean to it.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    rows = [(ids, (counts / (counts.sum() + PRIOR))[:, None].astype(np.float32), label) for ids, counts, label in rows]
    steps = max(1, epochs * len(rows))
    for step in range(epochs * len(rows)):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        ids, share, label = rows[order[step % len(rows)]]
        pace = rate * (1 - step / steps)
        own = vectors[ids]
        mean = (own * share).sum(axis=0)
        logits = mean @ weights + bias
        p = np.exp(logits - logits.max())
        wrong = p / p.sum() - (np.arange(2) == label)
        back = weights @ wrong
        weights -= pace * np.outer(mean, wrong)
        bias -= 0.1 * pace * wrong
        vectors[ids] = own - pace * share / max(float((share * share).sum()), 1e-9) * back
    towards = weights[:, 1] - weights[:, 0]
    return Model((vectors @ towards).astype(np.float32), float(bias[1] - bias[0]), bool(rows))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of an id as text leaves ``part``; never for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        ids, counts = zip(*[counted(t or "") for t in batch.column("text").to_pylist()], strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), batch.column("label")], ["doc_id", "ids", "counts", "label"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, **options) -> Model:
    """Trains on ``labels(doc_id, quality)`` of documents that are not held out.

    Training sees at most ``sample_rows`` documents of at most ``sample_chars`` characters each, those whose ids have
    the smallest MD5; only their feature counts come to the driver. Of several labels of a document the smallest counts;
    null labels and labels without a document count for nothing. A document that repeats is seen once per text.
    """
    known = labels.where("quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    short = docs.where(F.length("text") <= sample_chars).select("doc_id", "text")
    chosen = known.join(short.select("doc_id").distinct(), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows)
    texts = short.join(F.broadcast(chosen), "doc_id").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "CAST(label AS INT) AS label").dropDuplicates()
    rows = texts.mapInArrow(_counted_rows, "doc_id long, ids array<int>, counts array<float>, label int").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.size("ids")).limit(sample_rows)
    table = rows.toArrow()
    return train([(i.values.to_numpy(), c.values.to_numpy(), y.as_py()) for i, c, y in zip(*(table.column(n) for n in ("ids", "counts", "label")), strict=True)], **options)


def _score_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        scores = [model.value.score(t or "") for t in batch.column("text").to_pylist()]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())], [*kept, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null text counts as empty and scores as the bias alone.

    The broadcast model has a fixed size. Nothing is shuffled; repeated rows score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(partial(_score_rows, model=shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The documents that score at least ``least``, with the columns of ``docs``; all of them if the model saw no labelled document."""
    if not model.learned:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accepted_rows, model=shared, least=least), docs.schema)


def _accepted_rows(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        keep = [model.value.score(t or "") >= least for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))
