"""Spelling variants: words one edit apart, found through pivotal bigrams, and the form each word stands for (operator 12)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import stored
from rollcall.llm.words import by_bytes

#: Edits between near words, and characters of a gram: two disjoint pivots, of which one edit leaves one whole.
EDITS, GRAM = 1, 2
#: Shortest word and fewest occurrences, and how much more frequent a word's form must be.
SHORTEST, LEAST, RATIO = 6, 5, 5
#: A run whose hash this number divides loses a character.
DAMAGED = 199
#: Words that a task sums up before it hands them on.
HELD = 300_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def word_of(doc: int, run: str) -> str:
    """The word that a lower-cased run stands for in a document, ``doc`` being the hash of the document's id and a colon."""
    h = zlib.crc32(run.encode(), doc)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in by_bytes(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            doc = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUN.findall(text or "")).items():
                if len(run) >= SHORTEST and len(word := word_of(doc, run.translate(LOWER))) >= SHORTEST:
                    held[word] += n
        if len(held) > HELD:
            yield flush()
    yield flush()


def words(docs: DataFrame) -> DataFrame:
    """Words of at least ``SHORTEST`` characters that occur ``LEAST`` times or more in all documents: (word, n)."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_count_rows, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def gram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """Occurrences of every bigram in the words. The 90 letters of the words allow 8,100 bigrams at most."""
    grams = vocabulary.select(F.explode(F.expr(f"transform(sequence(1, char_length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram"))
    return {r.gram: r["count"] for r in grams.groupBy("gram").count().collect()}


def prefix_of(word: str, counts: dict[str, int]) -> list[int]:
    """Places of the word's rarest grams, as many as leave room for all pivots to be disjoint; in the order of places."""
    places = sorted(range(len(word) - GRAM + 1), key=lambda at: (counts[word[at : at + GRAM]], word[at : at + GRAM], at))
    return sorted(places[: GRAM * EDITS + 1])


def pivots_of(word: str, prefix: list[int], counts: dict[str, int]) -> list[int]:
    """Places of the disjoint prefix grams with the fewest occurrences together.

    best[k][i] is the least cost of k disjoint grams among the first i of the prefix, with the places chosen.
    """
    picks = EDITS + 1
    nothing = (float("inf"), [])
    best = [[(0, [])] * (len(prefix) + 1)] + [[nothing] * (len(prefix) + 1) for _ in range(picks)]
    for i, at in enumerate(prefix, 1):
        free = sum(other + GRAM <= at for other in prefix[: i - 1])  # grams that end before this one starts
        for k in range(1, picks + 1):
            cost, chosen = best[k - 1][free]
            best[k][i] = min(best[k][i - 1], (cost + counts[word[at : at + GRAM]], [*chosen, at]), key=lambda x: x[0])
    return best[picks][len(prefix)][1]


def contexts(word: str, at: int, before: bool) -> list[str]:
    """What joins along with the gram at a place, for an edit that lies before or after it.

    The side without the edit is equal in both words. On the other side, more than one character long, the edit leaves the
    character next to the gram or the outermost one; sides of one character or none are taken together.
    """
    same, other = (word[at + GRAM :], word[:at][::-1]) if before else (word[:at], word[at + GRAM :])
    mark = (">" if before else "<") + same
    out = [f"{mark}+{other[0]}", f"{mark}-{other[-1]}"] if other else []
    return out + ([f"{mark}="] if len(other) <= 1 else [])


def _signature_rows(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n", "pivot", "place", "gram", "context"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        for first in range(0, batch.num_rows, 10_000):
            part = batch.slice(first, 10_000)
            rows = []
            for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                prefix = prefix_of(word, counts)
                left, right = pivots_of(word, prefix, counts)
                # An edit lies after the left pivot or before the right one.
                for pivot, at, before in [(True, left, False), (True, right, True), *((False, at, before) for at in prefix for before in (False, True))]:
                    rows += [(word, n, pivot, at, word[at : at + GRAM], context) for context in contexts(word, at, before)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Every pair of words one inserted, deleted or replaced character apart, both ways: (word, near, near_n).

    An edit lies after a word's left pivot or before its right one; this pivot outlives it, moved by one place at most, and
    is among the rarest grams of the other word, or the same holds the other way round. What the edit leaves equal beside
    the gram (``contexts``) joins along with it, and the edit distance is checked in the join.
    """
    counts = gram_counts(vocabulary)
    rows = stored(vocabulary.mapInArrow(partial(_signature_rows, counts=counts), "word string, n long, pivot boolean, place int, gram string, context string"))
    pivots, prefixes = rows.where("pivot").alias("a"), rows.where("NOT pivot").alias("b")
    apart = F.expr(
        f"a.word <> b.word AND abs(a.place - b.place) <= {EDITS} AND abs(char_length(a.word) - char_length(b.word)) <= {EDITS} "
        f"AND levenshtein(a.word, b.word, {EDITS}) = {EDITS}"
    )
    same = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.context") == F.col("b.context"))
    found = pivots.join(prefixes, same & apart).selectExpr(
        "explode(array(struct(a.word AS word, b.word AS near, b.n AS near_n), struct(b.word AS word, a.word AS near, a.n AS near_n))) AS link"
    )
    return found.selectExpr("link.word", "link.near", "link.near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """The last word reached from each word of ``forms(word, form)``: (word, root).

    Each round doubles the steps taken; a form is ``RATIO`` times as frequent as its word, so ways are short and end.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.selectExpr("word AS root", "root AS further")
        ways = stored(ways.select("word", "root").join(further, "root", "left").selectExpr("word", "coalesce(further, root) AS root", "further IS NOT NULL AS moved"))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Words of all documents with the form each stands for: (word, form, root string, n, n_near, form_n long).

    A word's form is the most frequent of its near words (ties: the first in code-point order) if it occurs at least
    ``RATIO`` times as often; root follows the forms to their end and is the word itself where it has none.
    Null texts have no words; a null id reads as ``null`` in the hash; repeated rows count each; texts without
    words and empty tables give no rows; other columns are not read.
    """
    vocabulary = stored(words(docs))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(near, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"CASE WHEN -best.less >= {RATIO} * n THEN best.near END AS form", f"CASE WHEN -best.less >= {RATIO} * n THEN -best.less END AS form_n"
    )
    rows = stored(rows)
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
