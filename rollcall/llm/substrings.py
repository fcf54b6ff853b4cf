"""Removal of word sequences that an earlier document holds, by super-k-mer partitioning (operator 3)."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import partitions, stored
from rollcall.llm.words import PIECE_BYTES, by_bytes, hash_piece, hash_shingles, hash_words

WINDOW = 13
#: Words of a minimiser.
MINIMISER = 3
#: Text that one bucket gets on average, and beyond which its windows are dealt out once more, one by one.
BUCKET_BYTES = 2 << 20
LARGE_BYTES = 32 << 20

_MOVED = "bucket long, blob binary, row long, first long, past long"
_MOVED_ARROW = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("row", pa.int64()), ("first", pa.int64()), ("past", pa.int64())])


class Packs:
    """Packed strings on their way to buckets: each distinct string once, with the smallest id that holds it and where."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.docs: list[int] = []
        self.places: list[list[tuple[int, int]]] = []
        self.keys: list[int] = []
        self.ranges: list[tuple[int, int, int]] = []

    def add(self, text: bytes, key: int, doc: int, row: int, start: int, n_windows: int, window: int) -> None:
        """Ids must come in ascending order, so whoever brings a known string with a larger id loses all its words at once."""
        k = self.at.setdefault(text, len(self.docs))
        if k == len(self.docs):
            self.docs.append(doc)
            self.keys.append(key)
            self.places.append([(row, start)])
        elif self.docs[k] < doc:
            self.ranges.append((row, start, start + n_windows + window - 1))
        else:
            self.places[k].append((row, start))

    def batches(self, n_buckets: int) -> Iterator[pa.RecordBatch]:
        """One blob per bucket, and the words already lost, dealt out by row."""
        buckets = np.array(self.keys, np.uint64) % np.uint64(n_buckets)
        order = np.argsort(buckets, kind="stable")
        texts, packer = list(self.at), zstandard.ZstdCompressor(level=1)
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        numbers, blobs = [], []
        for part in np.split(order, cuts) if order.size else []:
            members = part.tolist()
            body = (b"\n".join([texts[i] for i in members]), [self.docs[i] for i in members], [self.places[i] for i in members])
            numbers.append(int(buckets[members[0]]))
            blobs.append(packer.compress(pickle.dumps(body, protocol=5)))
        if blobs:
            nothing = pa.nulls(len(blobs), pa.int64())
            for a in range(0, len(blobs), 64):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[a : a + 64], pa.int64()), pa.array(blobs[a : a + 64], pa.binary()), *[nothing[a : a + 64]] * 3], schema=_MOVED_ARROW)
        if self.ranges:
            row, first, past = np.array(self.ranges, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(row % n_buckets), pa.nulls(row.size, pa.binary()), pa.array(row), pa.array(first), pa.array(past)], schema=_MOVED_ARROW)


def minimisers(hashes: np.ndarray, window: int, width: int) -> np.ndarray:
    """The smallest hash of ``width`` consecutive words in every window of ``window`` words."""
    grams = hash_shingles(hashes, width)
    span, step = window - width + 1, 1
    while step * 2 <= span:
        grams, step = np.minimum(grams[:-step], grams[step:]), step * 2
    return np.minimum(grams[: grams.size - (span - step)], grams[span - step :]) if span > step else grams


def super_kmers(words: list[bytes], window: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(first word, windows, minimiser) of every run of consecutive windows that share a minimiser."""
    if len(words) < window:
        return
    least = minimisers(hash_words(words), window, width)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    yield from zip(starts.tolist(), np.diff(np.append(starts, least.size)).tolist(), least[starts].tolist(), strict=True)


def _pack_rows(batches: Iterator[pa.RecordBatch], n_buckets: int, window: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)
        packs = Packs()
        for doc, row, text in sorted((r for r in rows if r[0] is not None and r[2]), key=lambda r: r[:2]):
            words = text.encode().split()
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            for start, n, least in super_kmers(words, window, width):
                a = int(ends[start - 1]) + 1 if start else 0
                packs.add(joined[a : ends[start + n + window - 2]], least, doc, row, start, n, window)
        yield from packs.batches(n_buckets)


class Bucket:
    """The packed strings of one bucket, with the arrays of all their windows."""

    def __init__(self, blobs: list[bytes], window: int):
        texts: list[bytes] = []
        self.docs, self.places = [], []
        for blob in blobs:
            text, docs, places = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
            texts += text.split(b"\n")
            self.docs += docs
            self.places += places
        self.texts, self.window = texts, window
        parts, first, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text) + 1
            if size >= PIECE_BYTES or i == len(texts) - 1:
                parts.append(self._windows(first, i + 1))
                first, size = i + 1, 0
        self.hashes, self.owner, self.offset, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _windows(self, first: int, past: int) -> tuple[np.ndarray, ...]:
        """Hash, string, number within the string, and bytes from and to of every window of some strings."""
        hashes, starts, ends = hash_piece(b" ".join(self.texts[first:past]))
        sizes = np.array([t.count(b" ") + 1 for t in self.texts[first:past]])
        begins = np.cumsum(sizes) - sizes
        windows = sizes - self.window + 1
        owner = np.repeat(np.arange(past - first), windows)
        offset = np.arange(owner.size) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begins[owner] + offset
        origin = starts[begins][owner]
        return hash_shingles(hashes, self.window)[at], owner + first, offset, starts[at] - origin, ends[at + self.window - 1] - origin

    def text(self, k: int) -> bytes:
        return self.texts[self.owner[k]][self.start[k] : self.end[k]]

    def lost(self) -> np.ndarray:
        """Whether each window's words also start in a document with a smaller id: windows sorted by hash and id, equal neighbours compared as text."""
        docs = np.array(self.docs, np.int64)[self.owner]
        order = np.lexsort((docs, self.hashes))
        new = np.concatenate(([True], np.diff(self.hashes[order]) != 0))
        leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        lost = np.zeros(order.size, bool)
        later = order[docs[leader] < docs[order]]
        first = leader[docs[leader] < docs[order]]
        mixed = set()
        for k, f in zip(later.tolist(), first.tolist(), strict=True):
            if self.text(k) == self.text(f):
                lost[k] = True
            else:
                mixed.add(int(self.hashes[k]))
        for value in mixed:  # different windows with one hash
            least: dict[bytes, int] = {}
            members = np.flatnonzero(self.hashes == np.uint64(value)).tolist()
            for k in members:
                least[self.text(k)] = min(docs[k], least.get(self.text(k), docs[k]))
            for k in members:
                lost[k] = least[self.text(k)] < docs[k]
        return lost

    def ranges(self) -> np.ndarray:
        """Rows (row, first word, past word) of the words under lost windows."""
        lost = self.lost()
        new_owner = np.concatenate(([True], self.owner[1:] != self.owner[:-1]))
        begins = np.flatnonzero(lost & (new_owner | ~np.concatenate(([False], lost[:-1]))))
        stops = np.flatnonzero(lost & np.concatenate((new_owner[1:] | ~lost[1:], [True])))
        out = [
            (row, start + a, start + b + self.window)
            for k, a, b in zip(self.owner[begins].tolist(), self.offset[begins].tolist(), self.offset[stops].tolist(), strict=True)
            for row, start in self.places[k]
        ]
        return np.array(out, np.int64).reshape(-1, 3)

    def singles(self) -> Packs:
        """Every window as a packed string of its own, keyed by its hash."""
        packs = Packs()
        docs = np.array(self.docs, np.int64)[self.owner]
        for k in np.argsort(docs, kind="stable").tolist():
            for row, start in self.places[self.owner[k]]:
                packs.add(self.text(k), int(self.hashes[k]), int(docs[k]), row, start + int(self.offset[k]), 1, self.window)
        return packs


def _bucket_rows(batches: Iterator[pa.RecordBatch], n_buckets: int, window: int, large: int | None) -> Iterator[pa.RecordBatch]:
    """Reads blobs sorted by bucket; writes lost ranges, and the windows of too large buckets for a second round."""
    now, blobs, size, passed_on = None, [], 0, False

    def finish():
        if blobs and passed_on:
            yield from Bucket(blobs, window).singles().batches(n_buckets)
        elif blobs:
            row, first, past = Bucket(blobs, window).ranges().T
            yield pa.RecordBatch.from_arrays([pa.nulls(row.size, pa.int64()), pa.nulls(row.size, pa.binary()), pa.array(row), pa.array(first), pa.array(past)], schema=_MOVED_ARROW)

    for batch in batches:
        ready = batch.filter(batch.column("blob").is_null())
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(ready.num_rows, pa.int64()), *ready.columns[1:]], schema=_MOVED_ARROW)
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if blob is None:
                continue
            if bucket != now:
                yield from finish()
                now, blobs, size, passed_on = bucket, [], 0, False
            blobs.append(blob)
            size += zstandard.frame_content_size(blob)
            if large is not None and size > large:
                passed_on = True
                yield from finish()
                blobs, size = [], 0
                passed_on = True
    yield from finish()


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def lost_ranges(docs: DataFrame, window: int = WINDOW, width: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """(row, first, past): word ranges of ``docs(doc_id, text)`` under windows that also start in a document with a smaller id.

    A map task packs the consecutive windows that share a minimiser into one string and sends each distinct string of
    a few megabytes of text once, to the bucket of the minimiser; copies inside the task with a larger id are lost at
    once, so a passage that a third of all documents hold comes to its bucket once per task and batch. In the bucket,
    windows are sorted by hash and id and equal ones compared word by word. A bucket of over ``large_bytes`` deals its
    windows out again, each by its own hash. ``row`` is the hash of id and text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text")
    n = partitions(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8 * n, int(3 * total // bucket_bytes))
    moved = rows.mapInArrow(partial(_pack_rows, n_buckets=n_buckets, window=window, width=width), _MOVED)
    by_bucket = moved.repartition(n, "bucket").sortWithinPartitions("bucket")
    first = stored(by_bucket.mapInArrow(partial(_bucket_rows, n_buckets=n_buckets, window=window, large=large_bytes), _MOVED))
    again = first.where("blob IS NOT NULL OR bucket IS NOT NULL")
    ranges = first.where("blob IS NULL")
    if not again.isEmpty():
        dealt = again.repartition(n, "bucket").sortWithinPartitions("bucket")
        ranges = ranges.unionByName(dealt.mapInArrow(partial(_bucket_rows, n_buckets=n_buckets, window=window, large=None), _MOVED))
    return ranges.select("row", "first", "past")


def _kept(words: list[bytes], ranges: list) -> list[bytes]:
    if not ranges:
        return words
    keep = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        keep[r["first"]] += 1
        keep[r["past"]] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(keep)[:-1] == 0).tolist()]


def _cut_rows(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        counts, removed, digests, texts = [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            words = (text or "").encode().split()
            kept = _kept(words, ranges)
            joined = b" ".join(kept)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                texts.append(joined.decode())
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row of ``docs``: what is left without repeated windows.

    Words are runs without ASCII white space, unchanged; kept words are joined by one space. Windows are judged on the
    input. Null texts have no words. Rows with the same id do not take words from each other; rows without id neither
    take nor lose words. Other columns are not read; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = lost_ranges(own, window, **options)
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "past")).alias("ranges"))
    met = own.withColumn("row", _row()).join(lists, "row", "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return met.mapInArrow(partial(_cut_rows, with_text=with_text), schema)
